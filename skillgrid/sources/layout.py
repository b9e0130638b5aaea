"""Postings with typed time and normalised keys, laid out by month.

Dates are parsed and keys lower-cased once, when postings are written. Questions about recent postings then read the
months they need, and filters on time and keys reach the Parquet scan, where row groups are skipped by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillgrid.functions.text import parse_stamp, strip

KEYS = {"role": "role_norm", "company": "company_norm", "location": "location_norm"}
TYPED = ["scraped_ts", *KEYS.values(), "month"]


def typed_postings(postings: DataFrame) -> DataFrame:
    """Add scraped_ts (null if the text is no date), the keys that filters compare with, and month (yyyy-MM, last column)."""
    ts = parse_stamp(F.col("scraped_at"))
    return postings.select(
        *postings.columns, ts.alias("scraped_ts"),
        *(F.lower(strip(F.col(c))).alias(n) for c, n in KEYS.items()), F.date_format(ts, "yyyy-MM").alias("month"))


def is_typed(postings: DataFrame) -> bool:
    return set(TYPED) <= set(postings.columns)


def untyped(postings: DataFrame) -> DataFrame:
    return postings.drop(*TYPED)


def write_typed(postings: DataFrame, path: str) -> None:
    """One folder a month, sorted by location and role, so that row groups differ in the keys that filters name."""
    clustered(typed_postings(postings)).write.partitionBy("month").parquet(path)


def clustered(typed: DataFrame) -> DataFrame:
    """Rows of a month next to each other, spread by key, so that a month is a few files of many tasks."""
    return typed.repartitionByRange("month", "location_norm", "role_norm", "job_uid").sortWithinPartitions(
        "month", "location_norm", "role_norm")


def newest_ts(typed: DataFrame):
    """The newest date, read from the newest month alone; None if no posting has a date."""
    month = typed.agg(F.max("month")).first()[0]
    return None if month is None else typed.where(F.col("month") == month).agg(F.max("scraped_ts")).first()[0]
