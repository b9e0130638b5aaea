"""Shards by a hierarchical weighted hash tree, with DataFrame operations only.

A row descends region, rack and shard. At each node the children draw a number from the row's id and their own name,
scaled by their weight (exponential race: -ln(u) / weight, smallest wins), so a child wins in proportion to its weight
and the draws of the other children do not change when one weight does. Rows move only towards a child whose weight
grew, so movement stays inside subtrees whose weights change. A shard that is added gets a region of its own; its
weight is the only one that changes, so rows move only into the new shard.

There is no shuffle in the placement. Numbering the rows of a shard sorts pieces of a stated size, not whole shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ShardTree:
    """``regions[r][k]`` holds the weights of the shards in rack k of region r; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def regular(cls, regions: int = 2, racks: int = 3, shards: int = 4, weight: float = 1.0) -> ShardTree:
        return cls(tuple(tuple(tuple(weight for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    def with_shard(self, weight: float = 1.0) -> ShardTree:
        """One more shard, in a region of its own, numbered after all others."""
        return ShardTree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def levels(self) -> tuple[list, list, list]:
        """Children (number, weight) of the root, of every region and of every rack."""
        region_list, rack_lists, shard_lists = [], [], []
        rack = shard = 0
        for r, racks in enumerate(self.regions):
            region_list.append((r, sum(map(sum, racks))))
            rack_lists.append([])
            for weights in racks:
                rack_lists[-1].append((rack, float(sum(weights))))
                shard_lists.append([(shard + i, float(w)) for i, w in enumerate(weights)])
                rack, shard = rack + 1, shard + len(weights)
        return region_list, rack_lists, shard_lists


def _children(listed: list) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("child"), F.lit(float(w)).alias("weight")) for n, w in listed])


def _race(key: Column, level: str, children: Column) -> Column:
    """The child that wins the weighted draw; children without weight take no rows."""
    def drawn(child: Column) -> Column:
        # 52 bits of the hash as a fraction strictly between 0 and 1.
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["child"]), 12)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["child"].alias("child"))

    alive = F.filter(children, lambda c: c["weight"] > 0)
    return F.array_min(F.transform(alive, drawn))["child"]


def shard_of(df: DataFrame, key: str, tree: ShardTree, out: str) -> DataFrame:
    """Add ``out``, the shard of each row; rows with a null key all go to one and the same shard."""
    regions, racks, shards = tree.levels()
    region, rack = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(region, _race(F.col(key), "region", _children(regions)))
    df = df.withColumn(rack, _race(F.col(key), "rack", F.get(F.array(*map(_children, racks)), F.col(region))))
    df = df.withColumn(out, _race(F.col(key), "shard", F.get(F.array(*map(_children, shards)), F.col(rack))))
    return df.drop(region, rack)


def numbered(df: DataFrame, group: str, key: str, out: str, piece_rows: int = 200_000) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... inside each group, without a task that holds a whole group.

    Rows are dealt to pieces by a hash of the key; a piece starts where the earlier pieces of its group end. Rows with
    equal keys are numbered in any order: they are the same row but for columns that are not read here.
    """
    pieces = F.greatest(F.lit(1), F.ceil(df.agg(F.count("*")).scalar() / piece_rows))
    dealt = df.withColumn("_piece", F.pmod(F.xxhash64(key, F.lit("piece")), pieces))
    sizes = dealt.groupBy(group, "_piece").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(key))
    ranked = dealt.withColumn("_place", place)
    return ranked.join(starts, [group, "_piece"]).withColumn(
        out, (F.col("_start") + F.col("_place") - 1).cast("bigint")).drop("_piece", "_place", "_start")


def shard_documents(docs: DataFrame, tree: ShardTree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; a null text has no bytes and the checksum of no bytes, 0. ``slot`` is
    gapless from 0 in each shard. ``grown_shard`` is the shard with one more shard in the tree. Repeated rows get the
    same shard and slots of their own; a null id is a key like any other. An empty table gives no rows.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(body) + 8).cast("bigint").alias("size"),
                       F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"))
    placed = shard_of(shard_of(rows, "doc_id", tree, "shard"), "doc_id", tree.with_shard(), "grown_shard")
    return numbered(placed, "shard", "doc_id", "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
