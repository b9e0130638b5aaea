"""Look up a table by key when a few keys hold a large share of the asking rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PIECES = 1_000
SMALLEST_PIECE = 200


def spread_lookup(asking: DataFrame, table: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Left join of ``asking`` with a table of one row per key; the rows of a hot key are split over many tasks.

    A key is hot if it has at least one in ``PIECES`` of all asking rows. There can be no more than ``PIECES`` such
    keys, so the list of them is safe to broadcast. The table's row of a hot key is copied, once per piece.
    """
    counts = asking.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    piece = F.greatest(F.ceil(total / PIECES), F.lit(SMALLEST_PIECE))
    hot = F.broadcast(counts.where(F.col("_rows") > piece).select(
        *keys, F.ceil(F.col("_rows") / piece).cast("int").alias("_copies")))
    copies = F.coalesce("_copies", F.lit(1))

    split = asking.join(hot, keys, "left").withColumn("_copy", F.pmod(F.xxhash64(row_id), copies).cast("int"))
    copied = table.join(hot, keys, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    # The count is given, so adaptive execution does not merge small partitions: a lookup is followed by work that
    # costs far more than its input bytes suggest.
    parts = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = split.drop("_copies").repartition(parts, *keys, "_copy")
    return spread.join(copied.drop("_copies"), [*keys, "_copy"], "left").drop("_copy")
