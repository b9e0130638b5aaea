"""Demand kept up to date by signed changes: minus what the replaced postings counted, plus what the new ones do.

Rollup, cube and segments are sums over postings, so a change of a few postings is a small rollup of its own, which is
added. A segment's ranked list and its change meet in one worker and are summed there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.text import segment_key
from skillgrid.operators.demand import cube_segments

ROLLUP = ["role_norm", "company_norm", "location_norm", "skill"]


def _differing(skills: Column, others: Column, same: Column) -> Column:
    """Skills that count: where both sides are the ``same`` otherwise, those that only this side has."""
    # Lists with a skill twice are counted as they are, as are missing ones.
    plain = (F.size(F.array_distinct(skills)) == F.size(skills)) & (F.size(F.array_distinct(others)) == F.size(others))
    alike = F.coalesce(same & skills.isNotNull() & others.isNotNull() & plain, F.lit(False))
    return F.when(alike, F.array_except(skills, others)).otherwise(skills)


def signed_rollup(changes: DataFrame) -> DataFrame:
    """The change of the rollup when postings ``_old`` (null for none) become ``_new``; counts may be negative, none is zero.

    Both sides are counted in one pass; what a posting has before and after cancels out in its own row.
    """
    keys = {n: [segment_key(F.col(f"{side}.{c}")).alias(f"{side}{n}") for side in ("_new", "_old")]
            for n, c in zip(ROLLUP, ("role", "company", "location"))}
    keyed = changes.select(*[k for pair in keys.values() for k in pair], F.col("_new.skills").alias("_news"),
                           F.col("_old.skills").alias("_olds"))
    same = F.lit(True)
    for name in keys:
        same = same & F.col(f"_new{name}").eqNullSafe(F.col(f"_old{name}"))
    sides = [F.struct(*[F.col(f"{side}{n}").alias(n) for n in keys], _differing(F.col(own), F.col(other), same).alias("skills"),
                      F.lit(sign).cast("bigint").alias("sign"))
             for side, own, other, sign in (("_new", "_news", "_olds", 1), ("_old", "_olds", "_news", -1))]
    counted = keyed.select(F.inline(F.array(*sides))).select(*keys, F.explode("skills").alias("skill"), "sign")
    return counted.groupBy(*ROLLUP).agg(F.sum("sign").alias("demand_count")).where("demand_count <> 0")


def added(rollup: DataFrame, change: DataFrame) -> DataFrame:
    """A rollup with its change; what falls to zero goes."""
    return rollup.unionByName(change).groupBy(*ROLLUP).agg(F.sum("demand_count").alias("demand_count")).where(
        "demand_count <> 0").select(*rollup.columns)


def changed_segments(segments: DataFrame, change: DataFrame) -> DataFrame:
    """Segments with a change of the rollup: what its cube counts is added to their lists; empty segments go."""
    return cube_segments(change, onto=segments)
