"""Nearest vectors by a block matrix join.

Candidates and queries are packed into blocks. A task multiplies tiles of 8-bit vectors; the product and the known
rounding error of each vector bound the true distance from both sides. Per query, only pairs whose lower bound does not
exceed the smallest k-th upper bound known so far survive, and those are worked out in double precision on the original
vectors. Every task keeps one heap of k per query; the heaps of all tasks are merged at the end, again k per piece first.

Blocks meet by an equi-join on the query block's number. Each candidate block goes to every query block, which is the
stated query set against all rows; queries are never collected on the driver, and Spark broadcasts their table only if
its measured size is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skillgrid.session import stored

# Sums of products of 8-bit numbers stay exact in 32-bit floats up to this many dimensions.
_EXACT_DIMS = 1024


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit vectors, their scales, and the exact length of the rounding error of each."""
    largest = np.abs(vectors).max(axis=1)
    scale = np.where(largest > 0, largest, 1.0) / 127.0
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(vectors - small * scale[:, None], axis=1)
    return small, scale, error


def _bounds(query, candidate) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances of a tile; the slack covers rounding in double precision."""
    (q, qs, qe), (c, cs, ce) = query, candidate
    wide = np.float32 if q.shape[1] <= _EXACT_DIMS else np.float64
    dot = (q.astype(wide) @ c.astype(wide).T).astype(np.float64) * qs[:, None] * cs[None, :]
    norm = lambda x, s: (x.astype(np.float64) ** 2).sum(axis=1) * s ** 2
    qn, cn = norm(q, qs)[:, None], norm(c, cs)[None, :]
    square = np.maximum(qn + cn - 2 * dot, 0.0)
    apart, error = np.sqrt(square), qe[:, None] + ce[None, :]
    slack = 1e-6 * (np.sqrt(qn) + np.sqrt(cn)) + 1e-300
    return apart - error - slack, apart + error + slack


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, summed in the order of the dimensions."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += (left[:, d] - right[:, d]) ** 2
    return np.sqrt(total)


class _Heaps:
    """The k nearest so far of each query of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.tile = quantised(vectors)
        self.kth = np.full(len(ids), np.inf)
        self.found: list[list[tuple[float, int]]] = [[] for _ in ids]

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        low, high = _bounds(self.tile, quantised(vectors))
        own = self.ids[:, None] == ids[None, :]
        high = np.where(own, np.inf, high)
        limit = self.kth
        if len(ids) >= self.k:
            limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        rows, columns = np.nonzero((low <= limit[:, None]) & ~own)
        exact = distances(self.vectors[rows], vectors[columns])
        for q in np.unique(rows):
            mine = rows == q if len(rows) < 64 else slice(np.searchsorted(rows, q), np.searchsorted(rows, q, "right"))
            merged = sorted(self.found[q] + list(zip(exact[mine].tolist(), ids[columns[mine]].tolist())))[:self.k]
            self.found[q] = merged
            if len(merged) == self.k:
                self.kth[q] = merged[-1][0]

    def rows(self) -> pd.DataFrame:
        flat = [(q, i, d) for q, found in zip(self.ids.tolist(), self.found) for d, i in found]
        return pd.DataFrame(flat, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    doubles = vector.cast("array<double>")
    return F.coalesce(~F.exists(doubles, bad) & F.exists(doubles, lambda x: x != 0), F.lit(False))


def _packed(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("id")
    vectors = np.array(block["vector"].tolist(), dtype=np.float64)
    return pd.DataFrame({"dims": [vectors.shape[1]], "block": [int(block["block"].iloc[0])],
                         "ids": [block["id"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows packed into blocks of about ``block_rows`` vectors of one length, dealt by a hash of the id."""
    count = F.greatest(F.lit(1), F.ceil(rows.agg(F.count("*")).scalar() / block_rows))
    dealt = rows.withColumn("dims", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), count))
    return dealt.groupBy("dims", "block").applyInPandas(
        _packed, "dims int, block bigint, ids binary, vectors binary")


def _unpacked(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dims)


def _tiles(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, heaps = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if key != (row.dims, row.block):
                    if heaps is not None:
                        yield heaps.rows()
                    key, heaps = (row.dims, row.block), _Heaps(*_unpacked(row.ids, row.vectors, row.dims), k)
                heaps.meet(*_unpacked(row.c_ids, row.c_vectors, row.dims))
        if heaps is not None:
            yield heaps.rows()
    return run


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                    vector_col: str = "embedding", query_block: int = 1024, candidate_block: int = 4096,
                    slices: int = 64) -> DataFrame:
    """The ``k`` nearest other vectors of every query: query_id, rank, vec_id, score.

    Nearness is the Euclidean distance in double precision; ties go to the smaller id, and fewer candidates give fewer
    rows. Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id;
    vectors of another length than the query's have no distance to it. Repeated rows are one vector each of their own,
    but never neighbours of a query with the same id. Tables without queries or candidates give no rows.
    """
    good = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = stored(good.where(F.col("id").isNotNull() & usable(F.col("vector"))), "usable_vectors")
    asked = stored(_blocks(good.where("asks").dropDuplicates(["id"]).drop("asks"), query_block), "query_blocks")
    offered = stored(_blocks(good.drop("asks"), candidate_block), "candidate_blocks")
    given = offered.select("dims", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"),
                           F.col("vectors").alias("c_vectors"))
    # One row per pair of blocks. The query blocks are copied once per slice of candidates, so that a query block's work
    # is dealt over many tasks.
    numbers = asked.select("dims", "block")
    tiles = given.join(numbers, "dims").withColumn("slice", F.pmod("c_block", F.lit(slices)).cast("int"))
    sliced = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    work = tiles.join(sliced, ["dims", "block", "slice"])
    near = work.sortWithinPartitions("dims", "block", "c_block").select(
        "dims", "block", "ids", "vectors", "c_ids", "c_vectors").mapInPandas(
        _tiles(k), "query_id bigint, vec_id bigint, score double")
    order = [F.col("score"), F.col("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
