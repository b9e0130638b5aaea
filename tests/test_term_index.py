"""Tables of terms against plain regular expressions, and what the cost depends on."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from skillgrid.operators import tagging as T, term_index as X
from skillgrid.taxonomy import Taxonomy
from test_tagging import TERMS

PARTS = TERMS + [" ", " ", ".", "+", "#", "-", "  ", "\n", "_", "x", "1", "²", "é", "日本", "Vue.JS", "+++", ". "]


def random_texts(seed, n=300, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def found(spark, texts, terms, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    index = X.TermIndex.from_table(spark.createDataFrame([(t,) for t in terms], "term string"))
    rows = X.mentions_by_term(df, ["id"], "text", index, **options).collect()
    got = {i: {} for i in range(len(texts))}
    for r in rows:
        got[r.id][r.term] = r.mentions
    return got


@pytest.mark.parametrize("aware", [False, True])
def test_matches_regular_expressions(spark, aware):
    texts = [*random_texts(3), "c++ and .net", "c++, c++11 asp.net .net", "la la la la", "++", "+++", "a ++ b", "", None, "c++"]
    left, right = (r"(?<!\w)", r"(?!\w)") if aware else (r"\b", r"\b")
    got = found(spark, texts, [*TERMS, "C++", "", None], edge_aware=aware)
    for i, text in enumerate(texts):
        expected = {t: len(re.findall(left + re.escape(t) + right, (text or "").lower())) for t in TERMS}
        assert got[i] == {t: n for t, n in expected.items() if n}, repr(text)


def test_equals_the_projection_and_keeps_list_order(spark):
    texts = random_texts(9, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    taxonomy = Taxonomy.from_terms(TERMS)
    index = X.TermIndex.from_terms(spark, taxonomy)
    for run in (T.skill_mentions, T.top_skills):
        assert sorted(map(tuple, run(df, ["id"], "text", index).collect())) == sorted(
            map(tuple, run(df, ["id"], "text", taxonomy).collect()))


@pytest.mark.parametrize("size,overlap", [(5, 2), (3, 0), (40, 10)])
def test_chunk_counts_equal_tagged_chunks(spark, size, overlap):
    texts = [*random_texts(5, 120, 60), "", None, "la la la la la la la la", "c++x " * 9, "java " * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    taxonomy = Taxonomy.from_terms(TERMS)
    chunks = T.with_skill_hits(T.chunk_texts(df, ["id"], "text", size, overlap), "chunk_text", taxonomy)
    expected = chunks.select("id", F.explode("hits").alias("h")).groupBy("id", "h.skill").agg(F.max("h.mentions"))
    got = T.resume_skills(df, ["id"], "text", taxonomy, size, overlap)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_a_text_is_cut_once_for_all_chunks(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = T.resume_skills(df, ["doc_id"], "text", Taxonomy.from_terms(TERMS))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    assert len(scans) == 1 and "BroadcastHashJoin" in plan


def test_empty_tables(spark):
    no_terms = X.TermIndex.from_table(spark.createDataFrame([], "term string"))
    df = spark.createDataFrame([(1, "java")], "id int, text string")
    assert X.mentions_by_term(df, ["id"], "text", no_terms).count() == 0
    assert T.resume_skills(df, ["id"], "text", no_terms).count() == 0
    index = X.TermIndex.from_table(spark.createDataFrame([("java",)], "term string"))
    assert X.mentions_by_term(df.limit(0), ["id"], "text", index).count() == 0


def test_terms_come_from_tables_and_files(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("git\n\n ci/cd \n")
    assert {r.term for r in X.TermIndex.from_text_file(spark, str(tmp_path)).terms.collect()} == {"git", "ci/cd"}
    table = spark.createDataFrame([(2, "b"), (1, "a"), (3, "A"), (0, None)], "n int, term string")
    rows = X.TermIndex.from_table(table, order_by="n").terms.orderBy("position").collect()
    assert [(r.position, r.term, r.skill) for r in rows] == [(1, "a", "A"), (2, "b", "B")]


def test_a_large_table_is_met_by_a_shuffle(spark):
    """Without leave to broadcast, the same rows come out of a join that shuffles hits of both sides."""
    texts = random_texts(3, 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = found(spark, texts, TERMS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled == found(spark, texts, TERMS)


def test_cost_does_not_follow_the_number_of_terms(spark):
    """12 terms, and the same with 2,988 others that never occur: the same hits in less than twice the time."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8).cache()
    docs.count()
    few = ["the", "of", "in", "is", "la", "le", "des", "der", "und", "que", "on the", "by the"]
    many = few + [f"absent{i} term{i}" if i % 2 else f"absent{i}" for i in range(2988)]

    def clock(terms):
        best, rows = 9e9, None
        for taxonomy in (Taxonomy.from_terms(terms), X.TermIndex.from_terms(spark, Taxonomy.from_terms(terms))):
            for _ in range(3):
                start = time.perf_counter()
                rows = sorted(map(tuple, T.skill_mentions(docs, ["doc_id"], "text", taxonomy).collect()))
                best = min(best, time.perf_counter() - start)
            yield best, rows
            best = 9e9

    for (fast, small), (slow, large) in zip(clock(few), clock(many)):
        assert small == large and slow < 2 * fast + 0.5
    docs.unpersist()


def test_texts_with_keys_of_their_own_are_counted_in_their_rows(spark):
    """Nothing is shuffled for them; rows whose keys come again, null keys too, count as one text."""
    rows = [(1, "ab cd ab cd ab"), (2, "cd ab cd"), (2, "ab"), (None, "cd"), (None, "cd"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    index = X.TermIndex.from_table(spark.createDataFrame([("ab",), ("ab cd ab",), ("cd",)], "term string"))
    got = {(r.id, r.term): r.mentions for r in X.mentions_by_term(df, ["id"], "text", index).collect()}
    assert got == {(1, "ab"): 3, (1, "ab cd ab"): 1, (1, "cd"): 2, (2, "ab"): 2, (2, "cd"): 2, (None, "cd"): 2}
    own = X._mentions_in_rows(df.where("id = 1"), ["id"], "text", index)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Aggregate" not in plan
    assert sorted((r.term, r.mentions) for r in own.collect()) == [("ab", 3), ("ab cd ab", 1), ("cd", 2)]


def test_plain_words_in_rows_equal_regular_expressions(spark):
    words = ["ab", "cd", "ab cd ab", "cd  ab", "ab ab", "x"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "cd", "x", "abx", " ", " ", "  ", ", "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    got = found(spark, texts, words)
    for i, text in enumerate(texts):
        expected = {t: len(re.findall(rf"\b{re.escape(t)}\b", text)) for t in words}
        assert got[i] == {t: n for t, n in expected.items() if n}, repr(text)
