"""Tagging against a plain regular-expression loop, and the edges of its definition."""

import random
import re

from pyspark.sql import functions as F

from skillgrid.functions import text as X
from skillgrid.operators import tagging as T
from skillgrid.taxonomy import Taxonomy

TERMS = ["python", "java", "c++", "c#", ".net", "asp.net", "vue", "vue.js", "spring", "spring boot", "go", "r", "ci/cd",
         "node.js", "objective-c", "la la", "#x#", "é", "react native", "react", "++"]


def regex_hits(text, terms):
    found = {t: len(re.findall(r"\b" + re.escape(t) + r"\b", text.lower())) for t in dict.fromkeys(terms)}
    return {t: n for t, n in found.items() if n}


def spark_hits(spark, texts, terms):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = T.with_skill_hits(df, "text", Taxonomy.from_terms(terms)).collect()
    return {r.id: {h.term: h.mentions for h in r.hits} for r in rows}


def test_matches_regular_expressions_on_random_text(spark):
    rng = random.Random(7)
    parts = TERMS + [" ", " ", ".", "+", "#", "-", "  ", "\n", "_", "x", "1", "²", "́", "é", "日本", "Vue.JS", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = spark_hits(spark, texts, TERMS)
    for i, text in enumerate(texts):
        assert got[i] == regex_hits(text, TERMS), repr(text)


def test_edges(spark):
    texts = ["c++ and .net", "c++11", "asp.net", "vue.js vue", "", None, "la la la", "java javascript"]
    got = spark_hits(spark, texts, TERMS)
    assert got[0] == {} and got[4] == {} and got[5] == {}
    assert got[1] == {"c++": 1, "++": 1}
    assert got[2] == {"asp.net": 1, ".net": 1}
    assert got[3] == {"vue": 2, "vue.js": 1}
    assert got[6] == {"la la": 1}
    assert got[7] == {"java": 1}


def test_names_order_and_top(spark):
    # Fifteen skills of a sample posting and the form they are shown in.
    terms = ["python", "java", "react", "node.js", "mongodb", "aws", "azure", "docker", "kubernetes", "spark", "kafka",
             "airflow", "machine learning", "deep learning", "ci/cd"]
    taxonomy = Taxonomy.from_terms(terms)
    df = spark.createDataFrame([(1, "We use " + ", ".join(terms) + ". Spark again.")], "id int, text string")
    hits = T.with_skill_hits(df, "text", taxonomy)
    names = hits.select(T.skill_list(F.col("hits"))).first()[0]
    assert names == sorted(["Python", "Java", "React", "Node.Js", "Mongodb", "Aws", "Azure", "Docker", "Kubernetes",
                            "Spark", "Kafka", "Airflow", "Machine Learning", "Deep Learning", "Ci/Cd"])
    top = T.top_skills(df, ["id"], "text", taxonomy, 3).orderBy("rank").collect()
    assert [(r.skill, r.mentions) for r in top] == [("Spark", 2), ("Python", 1), ("Java", 1)]
    assert T.top_skills(df, ["id"], "text", taxonomy, None).count() == 15
    assert T.top_skills(df, ["id"], "text", taxonomy, 0).count() == 1


def test_required(spark):
    df = spark.createDataFrame([(1, "Python and c++11")], "id int, text string")
    got = {r.skill: r.found for r in T.required_skills(df, ["id"], "text", ["PYTHON", "C++", "Go"]).collect()}
    assert got == {"PYTHON": True, "C++": True, "Go": False}


def test_taxonomy_listing_keeps_double_entries(spark):
    taxonomy = Taxonomy.from_terms(["redis", "ci/cd", "Redis", "git"])
    assert [r.skill for r in taxonomy.display_list(spark).collect()] == ["Ci/Cd", "Git", "Redis", "Redis"]
    assert taxonomy.terms == ("redis", "ci/cd", "git")


def test_chunks(spark):
    sizes = {0: 0, 1: 1, 700: 1, 701: 2, 1310: 2, 1311: 3, 1921: 4}
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "id int, text string")
    chunks = T.chunk_texts(df, ["id"], "text").collect()
    for n, expected in sizes.items():
        mine = sorted((c.chunk, c.chunk_text.split()) for c in chunks if c.id == n)
        assert len(mine) == expected
        for k, (_, got) in enumerate(mine):
            assert got == [f"w{i}" for i in range(n)][610 * k:610 * k + 700]
    counted = {r.id: r.n for r in df.select("id", X.chunk_count(X.words(F.col("text"))).alias("n")).collect()}
    assert counted == sizes


def test_resume_report_of_empty_text(spark):
    df = spark.createDataFrame([(1, " \n "), (2, "python " * 701)], "id int, text string")
    rows = {r.id: r for r in T.resume_report(df, ["id"], "text", Taxonomy.from_terms(["python"])).collect()}
    assert (rows[1].extraction_mode, rows[1].chunks_processed, rows[1].skills_found, rows[1].taxonomy_size) == ("empty", 0, 0, 0)
    assert (rows[2].chunks_processed, rows[2].skill_details[0].score, len(rows[2].preview)) == (2, 700, 500)


def test_tagging_is_a_projection(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = T.with_skill_hits(df, "text", Taxonomy.from_terms(TERMS))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Join", "ArrowEval", "BatchEvalPython"))
    mentions = T.skill_mentions(df, ["doc_id"], "text", Taxonomy.from_terms(TERMS))
    plan = mentions._jdf.queryExecution().executedPlan().toString()
    # One pass over the text, and one for each of the two terms that overlap themselves.
    assert plan.count("\\E") == 2 * plan.count("+|[^\\p{L}\\p{N}_]+") > 0, plan


def test_postings_are_tagged_without_counting(spark):
    rows = [("Java dev", "java, git and c++x"), (None, "vue.js"), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "title string, description string")
    taxonomy = Taxonomy.from_terms(TERMS)
    tagged = T.tag_postings(df, taxonomy)
    hits = T.with_skill_hits(df.select(F.concat_ws(" ", "title", "description").alias("t")), "t", taxonomy)
    assert [r.skills for r in tagged.collect()] == [r.s for r in hits.select(T.skill_list(F.col("hits")).alias("s")).collect()]
    assert "mentions" not in tagged._jdf.queryExecution().analyzed().toString()
