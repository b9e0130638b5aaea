"""Skill gaps of resumes against the demand of their segment.

Input rows are requests that already carry their ``demand`` array, so every measure here works inside one row: no
join and no shuffle after the demand is attached. Names are compared ignoring case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.binding import bind
from skillgrid.functions.skills import CATEGORY_RULES, OTHER_CATEGORY, categorize, clamp, truncated_percent
from skillgrid.operators.unnest import unnest, unnest_structs


def _total(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + e["demand_count"])


def with_gap(answered: DataFrame) -> DataFrame:
    """Add matching and missing skills, score, counts and recommendations to each request."""
    resume = F.coalesce(F.col("resume_skills"), F.array().cast("array<string>"))
    df = answered.withColumn("_own", F.transform(resume, F.lower))
    df = df.withColumn("_have", F.array_distinct("_own"))
    df = df.withColumn("_hit", F.filter("demand", lambda d: F.array_contains("_have", F.lower(d["skill"]))))
    df = df.withColumn("_gap", F.filter("demand", lambda d: ~F.array_contains("_have", F.lower(d["skill"]))))

    # Matches are listed once per name: position of its first mention, spelling of its last.
    def match(name: Column, at: Column) -> Column:
        spelled = F.element_at(F.filter(resume, lambda s: F.lower(s) == name), -1)
        count = _total(F.filter("_hit", lambda d: F.lower(d["skill"]) == name))
        return F.struct((-count).alias("minus"), at.alias("at"), spelled.alias("skill"))

    wanted = F.filter("_have", lambda n: F.exists("_hit", lambda d: F.lower(d["skill"]) == n))
    df = df.withColumn("_wanted", wanted)
    df = df.withColumn("matching_skills", F.transform(
        F.sort_array(F.transform("_wanted", match)),
        lambda m: F.struct(m["skill"].alias("skill"), (-m["minus"]).alias("demand_count"))))
    df = df.withColumn("_advice", clamp(F.col("top_n"), 5, 100))
    df = df.withColumn("recommendations", recommendations(F.col("_gap"), F.col("_advice")))
    missing_cap = F.greatest(F.lit(20), F.col("_advice") * 2)
    return (
        df.withColumn("missing_skills", F.transform(
            F.slice("_gap", 1, missing_cap), lambda d: F.struct(d["skill"].alias("skill"),
                                                                d["demand_count"].alias("demand_count"))))
        .withColumn("skill_score", truncated_percent(_total(F.col("_hit")), _total(F.col("demand"))))
        .withColumn("resume_skill_count", F.size(resume))
        .withColumn("market_skill_count", F.size("demand"))
        .withColumn("match_count", F.size("_wanted"))
        .withColumn("gap_count", F.size("_gap"))
        .drop("_own", "_have", "_hit", "_gap", "_wanted", "_advice")
    )


def demand_reason(count: Column, skill: Column) -> Column:
    # The texts and their bounds.
    number = count.cast("string")
    band = (
        F.when(count > 100, F.concat(F.lit("Extremely high demand ("), number, F.lit("+ job postings)")))
        .when(count > 50, F.concat(F.lit("Very high demand ("), number, F.lit(" job postings)")))
        .when(count > 20, F.concat(F.lit("High demand ("), number, F.lit(" job postings)")))
        .otherwise(F.concat(F.lit("Moderate demand ("), number, F.lit(" job postings)")))
    )
    category = categorize(skill)
    return F.concat(band, F.when(category != "", F.concat(F.lit(" - "), category)).otherwise(F.lit("")))


def recommendations(missing: Column, top_n: Column) -> Column:
    """Missing skills in demand order with priority and reason."""
    return F.transform(F.slice(missing, 1, top_n), lambda d, i: F.struct(
        (i + 1).alias("rank"),
        d["skill"].alias("skill"),
        F.when(i < 5, F.lit("High")).otherwise(F.lit("Medium")).alias("priority"),
        demand_reason(d["demand_count"], d["skill"]).alias("reason"),
        d["demand_count"].alias("demand_count"),
    ))


def unfold(gaps: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row per entry of a result array, with its rank."""
    rows = unnest(gaps, keys, column)
    fields = [f.name for f in rows.schema["_item"].dataType.fields if f.name != "rank"]
    return rows.select(*keys, (F.col("_at") + 1).alias("rank"), *[F.col(f"_item.{f}").alias(f) for f in fields])


# The strict report knows only these two labels; every other category's skills are left out of it.
STRICT_CATEGORIES = ["Data Engineering", OTHER_CATEGORY]


def category_gaps(answered: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Per request and category with any demand: totals, truncated coverage and the top three missing skills."""
    labels = STRICT_CATEGORIES if strict else [label for label, _ in CATEGORY_RULES] + [OTHER_CATEGORY]
    resume = F.transform(F.coalesce(F.col("resume_skills"), F.array().cast("array<string>")), F.lower)
    flagged = F.transform("demand", lambda d: F.struct(
        F.coalesce(F.nullif(categorize(d["skill"]), F.lit("")), F.lit(OTHER_CATEGORY)).alias("category"),
        d["skill"].alias("skill"),
        F.array_contains(resume, F.lower(d["skill"])).alias("has"),
    ))
    groups = bind(flagged, lambda listed: F.transform(
        F.array(*[F.lit(x) for x in labels]),
        lambda c: F.struct(c.alias("category"), F.filter(listed, lambda f: f["category"] == c).alias("members"))))
    rows = unnest_structs(answered, keys, F.filter(groups, lambda g: F.size(g["members"]) > 0))
    total = F.size("members")
    has = F.size(F.filter("members", lambda m: m["has"]))
    lacking = F.transform(F.filter("members", lambda m: ~m["has"]), lambda m: m["skill"])
    return rows.select(
        *keys, "category",
        total.alias("total_skills"), has.alias("has_skills"), (total - has).alias("missing_skills"),
        truncated_percent(has, total).alias("coverage_percentage"),
        F.slice(lacking, 1, 3).alias("top_missing"),
    )
