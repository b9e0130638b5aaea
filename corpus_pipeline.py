"""The corpus pipeline: known language, exact copies, near copies, mix of sources, token ids.

Every stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns one
row per kept document with its token ids as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skillgrid.llm import exact_dedup, jaccard_join, language, mixing
from skillgrid.llm.common import ship_package, table
from skillgrid.llm.queries import encoded_digests
from skillgrid.session import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters have no language and go; all others stay."""
    return language.with_known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 on five-word shingles the smallest doc_id stays."""
    return jaccard_join.one_per_component(docs, jaccard_join.JaccardSettings(words=5, similar=80, whole=100))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none included."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mix: doc_id, n_tokens, ids_crc32, round_trip."""
    return encoded_digests(docs)


STAGES = [
    ("known language", known_language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

# The stages use trained profiles and a tokenizer file, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)
