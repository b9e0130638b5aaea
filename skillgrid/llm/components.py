"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillgrid.session import stored


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    Smallest labels travel along the links and are then followed once (pointer jumping), so long chains halve per round.
    Each round is a written table: no lineage grows and a lost executor repeats one round. Only a change flag reaches
    the driver.
    """
    one, other = F.col(left).alias("a"), F.col(right).alias("b")
    both = stored(links.select(one, other).unionByName(links.select(other.alias("a"), one.alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy(
            F.col("b").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("now"),
                                                 F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        after = stored(moved.join(jump, "now").select("node", F.least("now", "far").alias("component"), "was"), "labels")
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels
