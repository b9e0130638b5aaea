"""Packing documents into windows of fixed length by the sum-of-squares rule.

A document's ids are cut into full windows and a rest. The rest goes into the fill level that makes the sum of the squared
counts of partially filled windows smallest; a level array holds how many windows are open at each level. The rule keeps
the levels even, so that for most later rests there is a window which they fill up.

Documents are packed where they are read: no shuffle, one level array per task, and a task holds the ids of its open
windows only (at most ``max_open``). When a task ends, or holds too many, its open windows are emptied into each other from
the least filled on, which cuts pieces but leaves no padding. Less than one window remains; it is cut into windows whose lengths are
powers of two, which need no padding either. Windows are numbered over all tasks by a sum over one row per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from skillgrid.llm.byte_bpe import byte_bpe
from skillgrid.session import stored

_ROWS = 200  # texts encoded at a time
Piece = tuple[int, int, np.ndarray]  # document of the task, ids before it, ids


class FillLevels:
    """Open windows by fill level, and the change in the sum of squares that a placement makes."""

    def __init__(self, window: int):
        self.window = window
        self._clear()

    def _clear(self) -> None:
        window = self.window
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0
        never = np.iinfo(np.int64).max // 4
        self._never = never
        self._leave = np.full(window + 1, never)  # change when a window leaves the level
        self._leave[0] = 0  # a new window leaves no level
        self._enter = np.ones(window + 1, np.int64)  # change when one enters it
        self._enter[window] = 0  # a full one is no longer counted

    def _recount(self, level: int) -> None:
        n = len(self.open[level])
        self._leave[level] = 1 - 2 * n if n else self._never
        self._enter[level] = 2 * n + 1

    def best_level(self, size: int) -> int:
        """The level that takes ``size`` at the smallest sum of squares; the fullest among equals."""
        change = self._leave[:self.window - size + 1] + self._enter[size:]
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece into a window; the window if that fills it."""
        size = len(piece[2])
        level = self.best_level(size)
        if level:
            held = self.open[level].pop()
            self._recount(level)
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            return held
        self.open[level + size].append(held)
        self._recount(level + size)
        self.n_open += 1
        return None

    def drain(self) -> list[list[Piece]]:
        """Take out all open windows, the fullest first."""
        taken = [held for level in reversed(self.open) for held in level]
        self._clear()
        return taken


def _cut(pieces: list[Piece], sizes: Iterator[int]) -> Iterator[list[Piece]]:
    """Lay pieces end to end and cut them into windows of the given sizes."""
    size, held, free = next(sizes, 0), [], 0
    free = size
    for row, start, ids in pieces:
        while len(ids):
            part = ids[:free]
            held.append((row, start, part))
            start, ids, free = start + len(part), ids[len(part):], free - len(part)
            if not free:
                yield held
                held, free = [], next(sizes, 0)


def topped_up(windows: list[list[Piece]], window: int) -> Iterator[list[Piece]]:
    """Fill windows, the fullest first, with what the last ones hold; the rest as windows of powers of two."""
    fills = [sum(len(p[2]) for p in held) for held in windows]
    at, last = 0, len(windows) - 1
    while at < last:
        free = window - fills[at]
        while free and at < last:
            row, start, ids = windows[last].pop()
            # The end of a piece goes, so what stays begins where it did.
            keep = max(0, len(ids) - free)
            windows[at].append((row, start + keep, ids[keep:]))
            if keep:
                windows[last].append((row, start, ids[:keep]))
            moved = len(ids) - keep
            fills[last], fills[at], free = fills[last] - moved, fills[at] + moved, free - moved
            if not fills[last]:
                last -= 1
        if not free:
            yield windows[at]
            at += 1
    if at == last:
        rest = fills[at]
        if rest == window:
            yield windows[at]
        else:
            powers = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
            yield from _cut(windows[at], iter(powers))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text", max_open: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A document is its text's ids (strings of special tokens become their ids, none is added) and ``end_id``. A null or
    empty text is the end id alone. Rows are independent: repeated rows are packed each, null ids stay null, other
    columns are not read. An empty table gives no rows. A text of any length is cut; its task holds its ids.

    Every id stands in exactly one piece. Pieces of a sequence stand without gaps from offset 0, sequences are
    numbered without gaps from 0. A sequence holds ``window`` ids, or a power of two of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = byte_bpe(tokenizer_path).encode, TaskContext.get().partitionId()
        levels, ids_of_row, tokens_of_row, number, key = FillLevels(window), [], [], 0, None
        out: list[tuple] = []
        stop = np.array([end_id], np.uint32)

        def close(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for row, start, ids in pieces:
                out.append((ids_of_row[row], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                            tokens_of_row[row], number, offset))
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            types = [key, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * len(columns[0]), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["task", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset"])

        for batch in batches:
            key = batch["doc_id"].type
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist(), True)):
                    ids = np.append(ids, stop)
                    row = len(ids_of_row)
                    ids_of_row.append(doc_id)
                    tokens_of_row.append(len(ids))
                    for start in range(0, len(ids), window):
                        piece = (row, start, ids[start:start + window])
                        full = [piece] if len(piece[2]) == window else levels.place(piece)
                        if full:
                            close(full)
                    if levels.n_open > max_open:
                        for pieces in topped_up(levels.drain(), window):
                            if sum(len(p[2]) for p in pieces) == window:
                                close(pieces)
                            else:  # less than a window stays open, whatever powers of two it was cut into
                                for piece in pieces:
                                    if full := levels.place(piece):
                                        close(full)
                if len(out) >= 20_000:
                    yield flush()
        for pieces in topped_up(levels.drain(), window):
            close(pieces)
        if out:
            yield flush()

    packed = stored(rows.mapInArrow(run, f"task int, doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, "
                                         "doc_tokens bigint, window bigint, offset bigint"), "packed_pieces")
    per_task = packed.groupBy("task").agg((F.max("window") + 1).alias("_n"))  # one row per task
    before = F.sum("_n").over(Window.partitionBy().orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("task", F.coalesce(before, F.lit(0)).alias("_before"))
    return packed.join(starts, "task").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.col("window")).alias("sequence_id"),
        "offset")
