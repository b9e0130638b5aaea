"""Registered corpus queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from check import compare, connect  # noqa: E402
from odd_tables import ROWS  # noqa: E402
from skillgrid.llm.oracles import LLM_ORACLES  # noqa: E402
from skillgrid.llm.queries import LLM_QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


@pytest.mark.parametrize("name", list(LLM_QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_pipeline_stages(spark, sample_docs):
    docs, columns = sample_docs, sample_docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
    kept = docs.count()
    assert 0 < kept
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() == kept and out.where("NOT round_trip").count() == 0


def test_pipeline_on_odd_tables(spark, clashing_docs, no_docs):
    for docs in (clashing_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER) is not None
        empty = docs.limit(0)
        assert corpus_pipeline.STAGES[0][1](spark, empty, FOLDER).count() == 0
    language_kept = corpus_pipeline.known_language(spark, clashing_docs, FOLDER)
    assert language_kept.count() == len(ROWS) - 4
