"""Posting identity and the two ways to keep one copy: newest, or first to arrive.

Both rank copies of a key and keep rank 1. Spark prunes such a filter to one row per key on each map task before the
shuffle (window group limit), so a key that holds a large share of all rows does not travel as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skillgrid.functions.text import parse_stamp, strip


def posting_key() -> Column:
    """sha-256 over source, url, title and company; role and location are not part of the identity."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "url", "title", "company")]
    return F.sha2(strip(F.lower(F.concat_ws("|", *parts))), 256)


def with_posting_key(df: DataFrame) -> DataFrame:
    return df.withColumn("job_uid", posting_key())


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key under ``order``, which must be total for a repeatable result."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_postings(df: DataFrame, arrival: list[str]) -> DataFrame:
    """Within one ingest run the first copy of a posting wins."""
    return keep_first(df, ["job_uid"], list(arrival))


def newest_first() -> list[Column]:
    """Newest first, unparsable dates last; equal times are settled by source, url and role."""
    return [parse_stamp(F.col("scraped_at")).desc_nulls_last(), F.col("scraped_at").desc_nulls_last(),
            *[F.col(c).asc_nulls_last() for c in ("source", "url", "role")]]


def latest_postings(df: DataFrame) -> DataFrame:
    """Newest copy of each posting."""
    return keep_first(df, ["job_uid"], newest_first())


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Append by column name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _paired(stored: DataFrame, incoming: DataFrame, how: str) -> DataFrame:
    """job_uid, _old, _new, and whether the new copy is the one to keep (_take_new)."""
    columns = stored.columns
    fresh = latest_postings(union_all([stored.limit(0), incoming])).select(*columns)
    old = stored.withColumn("_old", F.struct(*columns))
    new = fresh.withColumn("_new", F.struct(*columns))
    pair = old.select("job_uid", "_old").join(new.select("job_uid", "_new"), "job_uid", how)

    def comes_before(a: str, b: str) -> Column:
        verdict, tied = F.lit(False), F.lit(True)
        keys = [(parse_stamp(F.col(f"{a}.scraped_at")), parse_stamp(F.col(f"{b}.scraped_at")), True),
                (F.col(f"{a}.scraped_at"), F.col(f"{b}.scraped_at"), True)]
        keys += [(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"), False) for c in ("source", "url", "role")]
        for x, y, descending in keys:
            better = (x > y) if descending else (x < y)
            wins = F.coalesce(better, x.isNotNull() & y.isNull())
            verdict = verdict | (tied & wins)
            tied = tied & x.eqNullSafe(y)
        return verdict

    take_new = F.col("_old").isNull() | (F.col("_new").isNotNull() & comes_before("_new", "_old"))
    return pair.withColumn("_take_new", take_new)


def merge_newest(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored postings (one row per key) merged with a batch of any size; the newer copy of each key stays.

    A full outer join on the key: when the stored table is bucketed by ``job_uid`` it is read in place and only the
    batch is shuffled. At equal times the same order as in ``latest_postings`` decides.
    """
    pair = _paired(stored, incoming, "full_outer")
    return pair.select(F.when(F.col("_take_new"), F.col("_new")).otherwise(F.col("_old")).alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in stored.columns])


def replaced_postings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """_old and _new of the postings that a merge changes: _old is null for those that are added."""
    return _paired(stored, incoming, "right").where("_take_new").select("_old", "_new")


def with_replaced(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``merge_newest`` for the ``_new`` side of ``replaced_postings``: one row per key, known to be the one to keep."""
    columns = stored.columns
    old = stored.select("job_uid", F.struct(*columns).alias("_old"))
    pair = old.join(new.select("job_uid", F.struct(*columns).alias("_new")), "job_uid", "full_outer")
    return pair.select(F.coalesce("_new", "_old").alias("_row")).select(
        *[F.col(f"_row.{c}").alias(c) for c in columns])
