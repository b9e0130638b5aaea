"""Job-board API payloads (landed as JSON text) to postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.text import collapse_spaces, contains_query, or_default, strip, utc_stamp
from skillgrid.operators.unnest import unnest


@dataclass(frozen=True)
class PayloadShape:
    """Where a source keeps its jobs and their fields; dotted names reach into nested objects."""

    root: str
    company: str
    location: str
    description: str
    url: str
    title: str = "title"
    default_location: str = "Remote"
    # Sources that search by place fall back to the searched place instead.
    searched_location: bool = False
    # Sources without a search of their own are filtered by the query text here.
    filter_by_query: bool = False

    def schema(self) -> str:
        """DDL of the payload, built from the field names used."""
        fields: dict[str, list[str]] = {}
        for path in (self.title, self.company, self.location, self.description, self.url):
            head, _, rest = path.partition(".")
            fields.setdefault(head, []).append(rest)
        parts = [f"{name}: string" if rests == [""] else
                 f"{name}: struct<{', '.join(f'{r}: string' for r in rests)}>" for name, rests in fields.items()]
        return f"struct<{self.root}: array<struct<{', '.join(parts)}>>>"


# The payload layouts of the supported sources.
SHAPES = {
    "adzuna": PayloadShape("results", "company.display_name", "location.display_name", "description", "redirect_url",
                           default_location="India", searched_location=True),
    "jooble": PayloadShape("jobs", "company", "location", "snippet", "link",
                           default_location="India", searched_location=True),
    "remotive": PayloadShape("jobs", "company_name", "candidate_required_location", "description", "url"),
    "arbeitnow": PayloadShape("data", "company_name", "location", "description", "url", filter_by_query=True),
}


def postings_from_payloads(payloads: DataFrame, source: str, scraped_at: Column | None = None,
                           keep: list[str] | None = None) -> DataFrame:
    """Payload rows (query, location, payload) of one source to postings, one per job.

    Payloads that are no valid JSON or lack the job list give no rows. ``keep`` names further input columns to carry,
    such as the arrival order.
    """
    shape = SHAPES[source]
    carried = keep or []
    parsed = payloads.withColumn("_body", F.from_json("payload", shape.schema()))
    jobs = unnest(parsed, ["query", "location", *carried], f"_body.{shape.root}", "_job", "position")
    place: Column | str = shape.default_location
    if shape.searched_location:
        place = F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit(shape.default_location))
    field = lambda name: F.col(f"_job.{name}")
    postings = jobs.where(F.col("_job").isNotNull()).select(
        F.lit(source).alias("source"),
        or_default(field(shape.title), "Unknown").alias("title"),
        or_default(field(shape.company), "Unknown").alias("company"),
        or_default(field(shape.location), place).alias("location"),
        F.col("query").alias("role"),
        strip(collapse_spaces(F.coalesce(field(shape.description), F.lit("")))).alias("description"),
        strip(F.coalesce(field(shape.url), F.lit(""))).alias("url"),
        (utc_stamp(F.current_timestamp()) if scraped_at is None else scraped_at).alias("scraped_at"),
        *carried, "position",
    )
    if shape.filter_by_query:
        postings = postings.where(contains_query(F.col("title"), F.col("description"), F.col("role")))
    return postings


def allowed_sources(df: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Keep the allowed sources (none named: all) that are not denied."""
    name = F.lower(strip(F.col("source")))
    listed = lambda names: [n.strip().lower() for n in names or [] if n.strip()]
    if listed(allow):
        df = df.where(name.isin(listed(allow)))
    if listed(deny):
        df = df.where(~name.isin(listed(deny)))
    return df


def search_plan(roles: DataFrame, companies: list[str], order_by: str) -> DataFrame:
    """Search texts: each role alone, then with each company; first of equal texts stays, ignoring case.

    ``roles`` is a table (role and its order column); ``companies`` a short list given by the caller.
    """
    texts = F.concat(F.array("role"), F.transform(
        F.array(*[F.lit(c) for c in companies]).cast("array<string>"), lambda c: F.concat_ws(" ", F.col("role"), c)))
    expanded = roles.select(F.col(order_by).alias("_major"), F.posexplode(texts).alias("_minor", "query"))
    first = expanded.groupBy(F.lower(strip(F.col("query"))).alias("_key")).agg(
        F.min(F.struct("_major", "_minor", "query")).alias("_first"))
    return first.select(F.col("_first._major").alias("role_position"), F.col("_first._minor").alias("company_position"),
                        F.col("_first.query").alias("query"))
