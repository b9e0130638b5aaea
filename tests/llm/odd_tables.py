"""Rows that every operator must take: defined results, no crash."""

from pyspark.sql import types as T

# Nulls, empty and blank texts, repeated rows, ties, a very long text, and column names that operators use themselves.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
    (2, "ALPHA beta gamma delta epsilon zeta eta THETA", "en", "b", 20),
    (3, None, "en", None, None),
    (4, "", None, "a", 0),
    (5, "   \n ", "fr", "b", 5),
    (6, "12 34 !!", "fr", "c", 8),
    (7, "Érable été École ça", "fr", "c", 19),
    (7, "Érable été École ça", "fr", "c", 19),
    (8, "x" * 9000, "en", "a", 9000),
    (9, ("le la les des une " * 3000).strip(), "fr", None, 50000),
    (None, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
    (10, "one", "en", "b", 3),
    (11, "ONE", "en", "b", 3),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ["keep_id", "kept", "shard", "slot", "size", "row", "score", "_row_key", "_text_sha", "_copy_number", "_id",
            "_text", "_h", "ids", "word", "text_md5"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
