"""Expressions shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skillgrid.session import ship_package, stored  # noqa: F401

# White space and words of the corpus contracts; the class is meant for Java, RE2 and Python patterns alike.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A pure ASCII text takes the short way, which gives the same letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def salted_lookup(asking: DataFrame, names: DataFrame, keys: list[str], digest: str, row: list[str],
                  share: int = 1_000) -> DataFrame:
    """Inner join of ``asking`` with one row per key in ``names``; rows of a hot key are dealt over many tasks.

    Both sides carry ``digest``, a hash of the keys. A digest is hot with over one in ``share`` of all asking rows, so
    at most ``share`` of them exist and their list has a proven bound for the broadcast. The keys themselves still
    decide the join, so equal digests of different keys do no harm.
    """
    counts = asking.groupBy(digest).agg(F.count("*").alias("_rows"))
    piece = F.greatest(F.ceil(counts.agg(F.sum("_rows")).scalar() / share), F.lit(200))
    hot = F.broadcast(counts.where(F.col("_rows") > piece).select(
        digest, F.ceil(F.col("_rows") / piece).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = asking.join(hot, digest, "left").withColumn("_salt", F.pmod(F.xxhash64(*row), salts).cast("int"))
    right = names.join(hot, digest, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    on = [digest, *keys, "_salt"]
    return left.drop("_salts").join(right.drop("_salts"), on).drop("_salt")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_rows(docs: DataFrame, decided: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """``docs`` without the rows that ``decided`` (doc_id, _h, _stays, _rows) drops, and repeated rows once.

    Rows are told apart by id and ``digest``. What goes is usually little: its keys are written, so Spark knows their
    size and need not shuffle the texts to take it out.
    """
    key = free_name(docs, "_row_digest")
    keyed = docs.withColumn(key, digest)
    gone = stored(decided.where("NOT _stays").select("doc_id", "_h"), "dropped_rows")
    again = stored(decided.where("_stays AND _rows > 1").select("doc_id", "_h"), "repeated_rows")

    def same(rows: DataFrame) -> Column:
        return (keyed[key] == rows["_h"]) & keyed[id_col].eqNullSafe(rows["doc_id"])

    once = keyed.join(gone, same(gone), "left_anti").join(again, same(again), "left_anti")
    repeated = keyed.join(again, same(again), "left_semi").dropDuplicates([id_col, key])
    return once.unionByName(repeated).drop(key)
