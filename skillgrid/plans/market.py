"""Questions about the stored postings as a whole: status, options for the filters, titles in demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skillgrid.functions.text import strip
from skillgrid.sources.layout import KEYS, is_typed


def market_status(postings: DataFrame) -> DataFrame:
    """One row: volume, distinct roles, companies and regions, newest scrape. Reads four columns."""
    return postings.agg(
        F.count("*").alias("total_jobs"),
        F.countDistinct("role").alias("total_roles"),
        F.countDistinct("company").alias("total_companies"),
        F.countDistinct("location").alias("total_regions"),
        F.max("scraped_at").alias("last_scraped_at"),
    ).withColumn("snapshot_ready", F.col("total_jobs") > 0)


def source_counts(postings: DataFrame) -> DataFrame:
    """Postings by source, largest first; rows without a source are not listed."""
    return (postings.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("postings"))
            .orderBy(F.desc("postings"), "source"))


def _stated(limit: int, most: int) -> int:
    """The limit as asked; out of range it is refused, not changed."""
    if not 1 <= int(limit) <= most:
        raise ValueError(f"limit must be from 1 to {most}, not {limit}")
    return int(limit)


def _matching(postings: DataFrame, role: str | None, company: str | None, region: str | None) -> DataFrame:
    """Rows under the given filters; stored keys are compared as they are, so the comparison reaches the scan."""
    typed = is_typed(postings)
    for column, value in (("role", role), ("company", company), ("location", region)):
        if value:
            key = F.col(KEYS[column]) if typed else F.lower(strip(F.col(column)))
            postings = postings.where(key == value.lower().strip())
    return postings


def filter_options(postings: DataFrame, role: str | None = None, company: str | None = None,
                   region: str | None = None, limit: int = 200) -> DataFrame:
    """Sorted distinct roles, companies and regions under the other filters, the first ``limit`` of each."""
    limit = _stated(limit, 1000)
    kept = _matching(postings, role, company, region).select("role", "company", "location")
    values = kept.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), strip(F.col(column)).alias("value"))
        for kind, column in (("roles", "role"), ("companies", "company"), ("regions", "location"))])))
    values = values.where((F.col("value") != "") & (F.lower("value") != "nan")).distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("value"))
    return values.withColumn("position", rank).where(F.col("position") <= limit)


def top_titles(postings: DataFrame, region: str | None = None, limit: int = 10) -> DataFrame:
    """Most frequent titles per region; one region, or all of them at once.

    Counted before ranking, so a busy region is spread over tasks; without a title column roles are counted.
    """
    limit = _stated(limit, 30)
    name = "title" if "title" in postings.columns else "role"
    rows = _matching(postings, None, None, region).select(F.lower(strip(F.col("location"))).alias("region"), strip(F.col(name)).alias("name"))
    counts = rows.where((F.col("name") != "") & F.col("region").isNotNull()).groupBy("region", "name").agg(
        F.count("*").alias("postings"))
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("postings"), "name"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)
