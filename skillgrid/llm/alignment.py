"""Alignment of two tokenizers' tokens of the same text.

Both tokenizers cut the same bytes, so their tokens are aligned by the byte offsets where tokens end. An offset where tokens
of both end is a shared cut. The cuts are found by divide and conquer: from the middle of an interval, bisecting one list for the
other's next end leads to the shared cut nearest on the right, else on the left; both halves follow. An interval without a cut
is a leaf group. All intervals of a batch of texts are worked on together, one level of the recursion at a time.

Inside a group, tokens are linked where their bytes overlap. How often an id pair is linked in the whole corpus is an
aggregation over pairs: texts are aligned in blocks of bounded size, a block gives each of its distinct pairs once, with its own
count; the sums come back to the blocks by a join, where each document's links look them up. So only distinct pairs per
block are shuffled, and no table of all pairs is held anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from skillgrid.llm.byte_bpe import byte_bpe
from skillgrid.session import stored

_BATCH_BYTES = 1 << 20  # texts aligned together
_ANSWERS = 1 << 16


class PieceTokens:
    """Encoder of a SentencePiece model; ``token_bytes`` has the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.token_bytes = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i)
                            else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self._model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def piece_tokens(path: str) -> PieceTokens:
    """Kept by the worker process for all its tasks."""
    return PieceTokens(path)


def shared_cuts(a: np.ndarray, b: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
                ) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (ascending) of the values both have, within intervals (a from, a to, b from, b to)."""
    found_a, found_b = [], []
    a_from, a_to, b_from, b_to = bounds
    while True:
        live = (a_from < a_to) & (b_from < b_to)
        a_from, a_to, b_from, b_to = a_from[live], a_to[live], b_from[live], b_to[live]
        if not len(a_from):
            break
        middle = (a_from + a_to) // 2
        cut_a = np.full(len(middle), -1)
        cut_b = np.full(len(middle), -1)

        # To the right: the next end in one list is looked up in the other, until one stands in both.
        open_, at = np.arange(len(middle)), middle.copy()
        while len(open_):
            other = np.searchsorted(b, a[at])
            inside = other < b_to[open_]
            open_, at, other = open_[inside], at[inside], other[inside]
            same = b[other] == a[at]
            cut_a[open_[same]], cut_b[open_[same]] = at[same], other[same]
            open_, other = open_[~same], other[~same]
            at = np.searchsorted(a, b[other])
            inside = at < a_to[open_]
            open_, at = open_[inside], at[inside]
        to_right = cut_a >= 0

        open_ = np.flatnonzero(~to_right & (middle > a_from))
        at = middle[open_] - 1
        while len(open_):
            other = np.searchsorted(b, a[at], "right") - 1
            inside = other >= b_from[open_]
            open_, at, other = open_[inside], at[inside], other[inside]
            same = b[other] == a[at]
            cut_a[open_[same]], cut_b[open_[same]] = at[same], other[same]
            open_, other = open_[~same], other[~same]
            at = np.searchsorted(a, b[other], "right") - 1
            inside = at >= a_from[open_]
            open_, at = open_[inside], at[inside]

        cut = cut_a >= 0
        i, j = cut_a[cut], cut_b[cut]
        found_a.append(i)
        found_b.append(j)
        # Between the middle and the cut there is none, so each half ends where the search began.
        left_to = np.where(to_right, np.minimum(middle, np.where(cut, cut_a, middle)), cut_a)[cut]
        right_to = np.where(to_right, a_to, middle)[cut]
        a_from, a_to, b_from, b_to = (np.concatenate((a_from[cut], i + 1)), np.concatenate((left_to, right_to)),
                                      np.concatenate((b_from[cut], j + 1)), np.concatenate((j, b_to[cut])))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


@dataclass
class Aligned:
    """A batch of texts: ids and group ends of all tokens of both sides, and the links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    last_a: np.ndarray  # whether a token is the last of its group
    last_b: np.ndarray
    link_a: np.ndarray  # places of the linked tokens
    link_b: np.ndarray


def _per_text(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Align texts given as ids of both tokenizers that cover the same bytes; ``sizes`` are the bytes of each id.

    A text may have no ids, then on both sides.
    """
    n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64) for ids in (ids_a, ids_b))
    # Texts stand end to end, so one list of ends is ascending over all of them.
    ends_a, ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    some = n_a > 0
    bounds = tuple(x[some] for x in (to_a - n_a, to_a - 1, to_b - n_b, to_b - 1))
    cuts_a, cuts_b = shared_cuts(ends_a, ends_b, bounds)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[cuts_a] = last_b[cuts_b] = True
    last_a[to_a[some] - 1] = last_b[to_b[some] - 1] = True
    # Between two neighbouring ends of either side lie the bytes that one pair of tokens shares.
    pieces = np.sort(np.concatenate((ends_a, ends_b[~last_b])), kind="stable")
    link_a, link_b = np.searchsorted(ends_a, pieces), np.searchsorted(ends_b, pieces)
    n_groups = _per_text(last_a, n_a)
    return Aligned(n_a, n_b, n_groups, n_a + n_b - n_groups, a, b, last_a, last_b, link_a, link_b)


def _labels(n: int, inner: str, last: str) -> list[bytes]:
    return [f"{i}{end}".encode() for i in range(n) for end in (inner, last)]


def group_texts(found: Aligned, labels: list[bytes], size_a: int) -> Iterator[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every text, ids in order; ``labels`` are those of A, then those of B."""
    group_a = np.cumsum(found.last_a) - found.last_a
    group_b = np.cumsum(found.last_b) - found.last_b
    upto_a = np.concatenate(([0], np.flatnonzero(found.last_a) + 1))
    upto_b = np.concatenate(([0], np.flatnonzero(found.last_b) + 1))
    order = np.empty(len(found.ids_a) + len(found.ids_b), np.int64)
    order[np.arange(len(found.ids_a)) + upto_b[group_a]] = 2 * found.ids_a + found.last_a
    order[np.arange(len(found.ids_b)) + upto_a[group_b + 1]] = 2 * (size_a + found.ids_b) + found.last_b
    begin = 0
    for n in (found.n_a + found.n_b).tolist():
        yield b"".join(map(labels.__getitem__, order[begin:begin + n].tolist()))[:-1]
        begin += n


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str):
    a, b = byte_bpe(path_a), piece_tokens(path_b)
    sizes = [np.array([len(t) for t in side.token_bytes], np.int64) for side in (a, b)]
    return a, b, *sizes, _labels(a.size, ",", "|") + _labels(b.size, ",", ";")


def _tokens(texts: list[str | None], a, b) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both sides; none where the text is empty or the bytes of a side's tokens are not those of the text."""
    none = np.zeros(0, np.int64)
    full = [t or "" for t in texts]
    ids_a, ids_b = a.encode([" " + t for t in full], False), b.encode(full)
    for i, text in enumerate(full):
        raw = (" " + text).encode("utf-8", "surrogatepass")
        if not text or any(b"".join(map(side.token_bytes.__getitem__, ids[i].tolist())) != raw
                           for side, ids in ((a, ids_a), (b, ids_b))):
            ids_a[i] = ids_b[i] = none
    return ids_a, ids_b


_BLOCK = ("block bigint, docs array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,"
          "groups_sha256:string>>, links binary, pairs array<bigint>, counts array<bigint>")
_DOCUMENT = ("doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
             "groups_sha256 string")


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Blocks of documents: what is known of each alone, its links as places in the block's distinct pairs, and their counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, sizes_a, sizes_b, labels = _sides(path_a, path_b)
        task, number, held, pairs, waiting, key = TaskContext.get().partitionId(), 0, [], [], 0, None
        codec = pa.Codec("zstd")

        def block() -> pa.RecordBatch:
            nonlocal number
            distinct, places, counts = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            struct = pa.StructArray.from_arrays(
                [pa.array([d[0] for d in held], key), *(pa.array([d[i] for d in held], pa.int64()) for i in range(1, 5)),
                 pa.array([d[5] for d in held], pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            links = codec.compress(places.astype("<i4").tobytes(), asbytes=True)
            whole = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                     for v in (struct, pa.array(distinct), pa.array(counts))]
            out = pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number]), whole[0], pa.array([links], pa.binary()), *whole[1:]],
                names=["block", "docs", "links", "pairs", "counts"])
            held.clear()
            pairs.clear()
            number += 1
            return out

        def add(ids: list, texts: list[str | None]) -> None:
            found = align(*_tokens(texts, a, b), sizes_a, sizes_b)
            pairs.append(found.ids_a[found.link_a] * b.size + found.ids_b[found.link_b])
            shas = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(found, labels, a.size)]
            held.extend(zip(ids, *(x.tolist() for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), shas))

        for batch in batches:
            key = batch["doc_id"].type
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(sizes):
                reach = np.cumsum(sizes[begin:begin + 2_000])
                n = max(1, int(np.searchsorted(reach, _BATCH_BYTES, "right")))
                part = batch.slice(begin, n)
                add(part["doc_id"].to_pylist(), part["text"].to_pylist())
                begin, waiting = begin + n, waiting + int(reach[n - 1])
                if waiting >= block_bytes:
                    yield block()
                    waiting = 0
        if held:
            yield block()

    return rows.mapInArrow(run, _BLOCK.format(kind=kind))


def _looked_up(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A block's answers come in the order of its pairs, then its documents: sum them up over the links."""
    totals, best = [], []
    for batch in batches:
        documents = batch["docs"].is_valid().to_numpy(zero_copy_only=False)
        begin = 0
        for at in [*np.flatnonzero(documents).tolist(), len(documents)]:
            totals.append(batch["total"].slice(begin, at - begin).to_numpy(zero_copy_only=False))
            best.append(batch["best"].slice(begin, at - begin).to_numpy(zero_copy_only=False))
            begin = at + 1
            if at == len(documents):
                break
            docs = batch["docs"].slice(at, 1).flatten()
            places = np.frombuffer(pa.decompress(batch["links"][at].as_buffer(), batch["n_links"][at].as_py() * 4, "zstd"), "<i4")
            of_pair = np.concatenate(totals).astype(np.int64), np.concatenate(best).astype(bool)
            n_links = docs.field("n_links").to_numpy(zero_copy_only=False)
            sums = [pa.array(_per_text(x[places] if len(places) else np.zeros(0, np.int64), n_links), pa.int64())
                    for x in (of_pair[1], of_pair[0])]
            totals, best = [], []
            columns = {name: docs.field(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            columns |= {"n_best": sums[0], "count_sum": sums[1]}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``path_a`` is a byte-level BPE file, which reads a space and the text; ``path_b`` a SentencePiece model, which adds
    the space itself. Special tokens in texts are plain text. Texts that are null or empty, or that a side's tokens do not give back
    byte by byte (U+2581 becomes a space, for one), have no tokens: zeros, and '' for the groups. Rows are independent:
    repeated rows count each, null ids stay null, other columns are not read. An empty table gives no rows. A task holds
    the tokens of ``block_bytes`` of text, or of one longer text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size_b = piece_tokens(path_b).size
    blocks = stored(aligned_blocks(docs, path_a, path_b, id_col, text_col, block_bytes), "aligned_blocks")
    pairs = blocks.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        "block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    # A block holds a pair once, so no pair has more rows than there are blocks.
    counted = stored(pairs.select("block", "pair", F.sum("n").over(Window.partitionBy("pair")).alias("total")), "pair_counts")
    of_b = (F.col("pair") % size_b).cast("int").alias("b")
    # One row per id of B: the vocabulary bounds this table.
    highest = counted.groupBy(of_b).agg(F.max("total").alias("highest"))
    answers = counted.withColumn("b", of_b).join(F.broadcast(highest), "b").select(
        "block", "pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    heads = blocks.select("block", "docs", "links", F.aggregate(
        "docs", F.lit(0).cast("bigint"), lambda sum_, d: sum_ + d["n_links"]).alias("n_links"))
    # Pairs of a block come in their own order, its documents last.
    both = answers.unionByName(heads, allowMissingColumns=True).repartition("block").sortWithinPartitions(
        "block", F.col("pair").asc_nulls_last())
    out = _DOCUMENT.format(kind=kind)
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
    return both.select("docs", "links", "n_links", "total", "best").mapInArrow(lambda b: _looked_up(b, schema), out)
