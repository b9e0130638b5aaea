"""Column expressions against their Python counterparts."""

import unicodedata

from pyspark.sql import functions as F

from skillgrid.functions import skills as S, text as X


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expression(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_strip_and_spaces_follow_python(spark):
    values = ["\t a b \n", " x ", "\x1cz\x1f", "", "  ", "a　  b"]
    assert column(spark, values, X.strip) == [v.strip() for v in values]
    import re
    assert column(spark, values, X.collapse_spaces) == [re.sub(r"\s+", " ", v) for v in values]
    assert column(spark, values, lambda c: F.array_join(X.words(c), "|")) == ["|".join(v.split()) for v in values]


def test_title_case_follows_python(spark):
    values = ["node.js", "ci/cd", "d3.js", "machine LEARNING", "3d x2y", "o'neil", "élan über", "", "c++"]
    assert column(spark, values, X.title_case) == [v.title() for v in values]


def test_clean_text(spark):
    raw = "A\r\nB\rC\t\tD    E\n\n\n\nF G​H\x07 \n"
    assert column(spark, [raw, None, ""], X.clean_text) == ["A\nB\nC D E\n\nFGH", "", ""]
    every = "".join(chr(c) for c in range(0x250)) + " 　﻿"
    got = column(spark, ["x" + every + "x"], X.clean_text)[0]
    import re
    want = ("x" + every + "x").replace("\r\n", "\n").replace("\r", "\n")
    want = re.sub(r"[ ]{2,}", " ", re.sub(r"\n{3,}", "\n\n", re.sub(r"\t+", " ", want)))
    assert got == "".join(c for c in want if c.isprintable() or c == "\n").strip()
    assert unicodedata.category("﻿") == "Cf"


def test_parse_skill_cell(spark):
    values = ['["a", " b ", ""]', "['x', 'y']", "a, b,,c ", "[broken", "[a, b]", "", None, "  "]
    got = column(spark, values, lambda c: F.array_join(X.parse_skill_cell(c), "|"))
    assert got == ["a|b", "x|y", "a|b|c", "[broken", "[a|b]", "", "", ""]


def test_defaults(spark):
    values = [None, "", "  ", " a "]
    assert column(spark, values, lambda c: X.or_default(c, "Unknown")) == ["Unknown", "Unknown", "", "a"]
    assert column(spark, values, lambda c: X.shown_or_default(c, "Unknown")) == ["Unknown", "Unknown", "Unknown", "a"]
    assert column(spark, values, X.filter_key) == [None, None, "", "a"]


def test_links(spark):
    got = column(spark, ["/a", "https://x/y", "", None],
                 lambda c: X.absolute_link(F.coalesce(c, F.lit("")), F.lit("https://b"), F.lit("https://page")))
    assert got == ["https://b/a", "https://x/y", "https://page", "https://page"]


def test_normalize(spark):
    got = column(spark, [["PyTorch", "ML", "React.js", "AI"], [" ", "K8S", "kubernetes", "node", "d3.js", "D3.JS"], []],
                 S.normalize_skills, "array<string>")
    assert got == [["PyTorch", "Machine Learning", "React"], ["Kubernetes", "Node.js", "D3.Js"], []]


def test_categories(spark):
    values = ["MongoDB", "Django", "Airflow", "AWS", "MySQL", "Docker", "Vue.Js", "Kafka", "Git", "Tailwind", "Google Cloud"]
    assert column(spark, values, S.categorize) == [
        "Programming Language", "Programming Language", "AI/Machine Learning", "Cloud Platform", "Database Technology",
        "DevOps/Infrastructure", "Web Framework", "Data Engineering", "", "AI/Machine Learning", "Programming Language"]


def test_scores(spark):
    df = spark.createDataFrame([(1, 8), (29, 100), (3, 3), (20, 20)], "m int, n int")
    rows = df.select(S.fit_score(F.col("m"), F.col("n")).alias("fit"),
                     S.truncated_percent(F.col("m"), F.col("n")).alias("pct")).collect()
    assert [tuple(r) for r in rows] == [(15, 12), (44, 28), (100, 100), (100, 100)]
    df = spark.createDataFrame([(["A", "b"], ["a", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0]


def test_stamps(spark):
    got = column(spark, ["2024-05-01T10:00:00+00:00", "nope", None], X.parse_stamp)
    assert got[0] is not None and got[1] is None and got[2] is None


def test_a_skill_is_lower_cased_once_for_all_category_rules(spark):
    names = ["JavaScript", "Private CLOUD", "MySQL", "Rails", "Deep Learning", "welding", None]
    df = spark.createDataFrame([(n,) for n in names], "s string").select(
        F.get(F.transform(F.array("s"), S.categorize), F.lit(0)).alias("c"))
    assert [r.c for r in df.collect()] == [
        "Programming Language", "Cloud Platform", "Database Technology", "AI/Machine Learning", "AI/Machine Learning", "", ""]
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 1
