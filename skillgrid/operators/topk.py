"""Top rows per group that stay spread out when one group is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, spread_by: str,
                  pieces: int = 64) -> DataFrame:
    """The first ``k`` rows of each group under a total order, exact.

    A group is first cut into ``pieces`` by a hash of ``spread_by`` and each piece keeps its own first ``k``; the final
    ranking of a group then sees at most ``pieces * k`` rows however large the group is. Both rankings are pruned on
    the map side too (window group limit).
    """
    piece = F.pmod(F.xxhash64(spread_by), F.lit(pieces))
    part = df.withColumn("_piece", piece)
    part = part.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    part = part.where(F.col("_rank") <= k).drop("_piece", "_rank")
    ranked = part.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")
