"""Requests against skill sets in tiles: equal sets are scored once, and only the sets that can be shown are kept.

A tile holds a bounded number of requests and of sets of a segment; Spark deals them, and inside a tile the overlaps of
all pairs come from one product of two 0/1 matrices. Small segments share a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from skillgrid.operators.spread import spread_lookup
from skillgrid.session import ship_package, stored

# Requests of a tile whose overlaps are held at once.
AT_ONCE = 256

BEST = "array<struct<set_id:bigint,fit:int,count:int,aligned:bigint,first:string>>"


def _fit_points(size: int, matched: int) -> np.ndarray:
    """``fit_score`` for all numbers of wanted (rows) and matched skills (columns)."""
    wanted, hit = np.arange(size + 1)[:, None], np.arange(matched + 1)[None, :]
    coverage = np.rint(hit / np.maximum(1, wanted) * 100).astype(np.int64)
    return np.minimum(100, coverage + np.minimum(15, hit * 3))


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of a list column in a row, and the length of each list."""
    lists = column.combine_chunks()
    return lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _segment_best(asks: pa.Table, sets: pa.Table, keep: int) -> pa.Table:
    n = sets.num_rows
    names, sizes = _lists(sets["names"])
    set_of = np.repeat(np.arange(n), sizes)
    ages, cells = _lists(sets["ages"])
    ages, counts = ages.to_numpy(), _lists(sets["counts"])[0].to_numpy()
    firsts = _lists(sets["firsts"])[0]
    place = np.argsort(np.argsort(np.array(firsts.to_pylist(), dtype=object), kind="stable"), kind="stable")
    starts = np.concatenate([[0], np.cumsum(cells)[:-1]])  # every set has a posting, so no list is empty
    at_place = np.empty(len(place), np.int64)
    at_place[place] = np.arange(len(place))

    totals, offsets, picked = [], [0], []
    for low in range(0, asks.num_rows, AT_ONCE):
        some = asks.slice(low, AT_ONCE)
        mine, owned = _lists(some["mine"])
        weights = _lists(some["weights"])[0].to_numpy()
        words = mine.unique()
        code, ask_of = _places(words, mine), np.repeat(np.arange(some.num_rows), owned)
        of_name = _places(words, names)
        known = of_name >= 0
        has = np.zeros((n, len(words)), np.float32)
        has[set_of[known], of_name[known]] = 1
        own = np.zeros((len(words), some.num_rows), np.float32)
        own[code, ask_of] = 1
        worth = np.zeros((len(words), some.num_rows))
        worth[code, ask_of] = weights
        matched = (has @ own).astype(np.int32)
        most = int(matched.max(initial=0)) + 1
        points = (_fit_points(int(sizes.max(initial=0)), most - 1) * most + np.arange(most)).astype(np.int32)
        points[:, 0] = 0  # no overlap, not to be shown
        key = points[sizes[:, None], matched]

        days = some["days"].to_numpy()
        total, found = np.zeros(some.num_rows, np.int64), []
        for d in np.unique(days):
            cols = np.flatnonzero(days == d)
            young = ages <= d
            held = np.add.reduceat(np.where(young, counts, 0), starts)
            first = np.minimum.reduceat(np.where(young, place, len(place)), starts)
            here = np.flatnonzero(held)
            if not len(here):
                continue
            part = key[np.ix_(here, cols)]
            total[cols] = np.rint(held[here].astype(np.float64) @ (part > 0)).astype(np.int64)
            floor = 1
            if len(here) > keep:
                floor = np.maximum(1, np.partition(part, len(here) - keep, axis=0)[len(here) - keep])
            col, row = np.nonzero((part >= floor).T)
            row, col = here[row], cols[col]
            # Exact, as sums of counts stay far below 2**53.
            aligned = (has.astype(np.float64) @ worth[:, cols])[row, np.searchsorted(cols, col)].astype(np.int64)
            order = np.lexsort((first[row], -aligned, -key[row, col], col))
            row, col, aligned = row[order], col[order], aligned[order]
            nth = np.arange(len(col)) - np.searchsorted(col, col)
            top = nth < keep
            row, col, aligned = row[top], col[top], aligned[top]
            found.append(np.stack([col, row, key[row, col], aligned, first[row]]))
        of_some = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        of_some = of_some[:, np.argsort(of_some[0], kind="stable")]
        offsets.extend(offsets[-1] + np.cumsum(np.bincount(of_some[0], minlength=some.num_rows)))
        totals.append(total)
        picked.append(np.stack([of_some[1], of_some[2] // most, of_some[2] % most, of_some[3], at_place[of_some[4]]]))
    row, fit, count, aligned, first = np.concatenate(picked, axis=1)
    best = pa.StructArray.from_arrays(
        [sets["set_id"].combine_chunks().take(pa.array(row)), pa.array(fit, pa.int32()), pa.array(count, pa.int32()),
         pa.array(aligned, pa.int64()), firsts.take(pa.array(first))], ["set_id", "fit", "count", "aligned", "first"])
    return pa.table({"_ask": asks["_ask"], "days": asks["days"], "total": pa.array(np.concatenate(totals)),
                     "best": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), best)})


def _places(words: pa.Array, entries: pa.Array) -> np.ndarray:
    """Place of each entry in ``words``, -1 for none."""
    return pc.fill_null(pc.index_in(entries, value_set=words), -1).to_numpy(zero_copy_only=False)


def _tile_best(keep: int):
    def run(asks: pa.Table, sets: pa.Table) -> pa.Table:
        asks, sets = asks.sort_by("_segment"), sets.sort_by("_segment")
        ours, theirs = asks["_segment"].to_numpy(), sets["_segment"].to_numpy()
        done = []
        for segment in np.intersect1d(ours, theirs):
            a, b = (np.searchsorted(x, [segment, segment + 1]) for x in (ours, theirs))
            done.append(_segment_best(asks.slice(a[0], a[1] - a[0]), sets.slice(b[0], b[1] - b[0]), keep))
        if done:
            return pa.concat_tables(done)
        entry = pa.struct([("set_id", pa.int64()), ("fit", pa.int32()), ("count", pa.int32()), ("aligned", pa.int64()),
                           ("first", pa.string())])
        return pa.schema([("_ask", pa.string()), ("days", pa.int32()), ("total", pa.int64()),
                          ("best", pa.list_(entry))]).empty_table()

    return run


def best_sets(asks: DataFrame, sets: DataFrame, keys: list[str], keep: int, sets_size: int, asks_size: int) -> DataFrame:
    """_ask, days, total and best (the ``keep`` best sets) per request and part of its segment's sets.

    ``asks`` has _ask, ``keys``, mine, weights (demand of each skill of mine) and days; ``sets`` has set_id, ``keys``,
    names, and ages, counts and firsts: per age in days how many postings have the set, and the smallest key of one. ``total``
    counts postings that share a skill and are at most ``days`` old. Sets rank by fit, overlap, alignment and the smallest
    key in the window, so the ``keep`` best postings are all in the ``keep`` best sets. Both tables are read more than once.
    """
    ship_package(asks.sparkSession)
    sizes = asks.groupBy(*keys).agg(F.count("*").alias("_asks")).join(
        sets.groupBy(*keys).agg(F.count("*").alias("_sets")), keys)
    dealt = stored(sizes.select(
        *keys, F.monotonically_increasing_id().alias("_segment"), "_asks", "_sets",
        F.ceil(F.col("_sets") / sets_size).cast("int").alias("_parts"),
        F.ceil(F.col("_asks") / asks_size).cast("int").alias("_chunks")), "segment_tiles")
    small = (F.col("_parts") == 1) & (F.col("_chunks") == 1)
    shared = dealt.where(small).agg(F.greatest(
        F.lit(1), F.ceil(F.sum("_sets") / sets_size), F.ceil(F.sum("_asks") / asks_size)).cast("bigint")).scalar()
    group = F.when(small, -1 - F.pmod(F.xxhash64("_segment"), shared)).otherwise(F.col("_segment"))
    dealt = dealt.withColumn("_group", group).drop("_asks", "_sets")

    def chosen(of: str, id_column: str):
        return F.pmod(F.xxhash64(id_column), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def located(rows: DataFrame, id_column: str) -> DataFrame:
        return spread_lookup(rows, dealt, keys, id_column).where("_segment IS NOT NULL")

    tile = ["_group", "_part", "_chunk"]
    left = located(asks, "_ask").withColumn("_chunk", chosen("_chunks", "_ask")).withColumn("_part", every("_parts"))
    right = located(sets, "set_id").withColumn("_part", chosen("_parts", "set_id")).withColumn("_chunk", every("_chunks"))
    left = left.select(*tile, "_segment", "_ask", "mine", "weights", "days")
    right = right.select(*tile, "_segment", "set_id", "names", "ages", "counts", "firsts")
    # The count is given, so adaptive execution does not merge small partitions: a tile costs more than its bytes suggest.
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both sides hold columns of the same table; named anew, they are told apart.
    left, right = (side.toDF(*side.columns).repartition(parts, *tile) for side in (left, right))
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(
        _tile_best(keep), f"_ask string, days int, total bigint, best {BEST}")
