"""SentencePiece encoding and decoding with a relational lattice.

A text is cut into units where no piece of the vocabulary can cross (before white space, around characters that stand in no
longer piece), so units are encoded apart. The lattice of a unit is relational: its substrings of bounded length are
exploded, equi-joined with the piece table (fixed size, broadcast), and grouped by unit again without another shuffle. A
higher-order aggregate folds the edges into the encoding: by Viterbi for unigram models (best sum of scores), by merges for
BPE models (the best-scored edge that joins two adjacent pieces, leftmost first), since the best sum is not what a
BPE model means.

The lattice is built for the units that make up at least ``share`` of all units of the corpus; at most 1 / share of these
exist, so their encodings may be broadcast, and texts are then encoded in place without a shuffle. All other units, and
very long ones, are cut further wherever no piece holds both neighbours, and their parts encoded by the same merge rule,
remembered by the worker process. Both ways are exact, so the share only moves work.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skillgrid.session import stored

SPACE = "▁"
_LONGEST_UNIT = 64  # characters of a unit that goes through the lattice
_LONGEST_LOOP = 24  # characters of a part whose merges are found by a plain loop
_MEMO = 350_000
_ROWS = 200  # texts that are held as Python objects together
_DECODED = 50  # rows that are decoded together


@dataclass(frozen=True)
class PieceModel:
    """Pieces of a model: text, id and score of the normal ones, and the ids of single bytes."""

    pieces: dict[str, tuple[float, int]]
    byte_ids: tuple[int, ...]
    texts: list[bytes] = field(repr=False)  # what each id adds to a decoded text

    @classmethod
    def from_file(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, single, texts = {}, {}, []
        for i in range(sp.vocab_size()):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                single[int(text[3:-1], 16)] = i
                texts.append(bytes([int(text[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                texts.append(b"")
            else:
                pieces[text] = (sp.get_score(i), i)
                texts.append(text.replace(SPACE, " ").encode())
        return cls(pieces, tuple(single[b] for b in range(256)), texts)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @cached_property
    def unit_pattern(self) -> str:
        """Units: white space with what follows it. Controls that stand in no longer piece are units of their own."""
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        assert not any(SPACE in p.lstrip(SPACE) for p in self.pieces), "a piece goes on after white space"
        lone = "".join(rf"\x{ord(c):02x}" for c in "\t\n\x0b\x0c" if c not in joined)
        return rf"[{lone}]|{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" if lone else rf"{SPACE}+[^{SPACE}]*"

    @cached_property
    def lone_newline(self) -> bool:
        return not any("\n" in p for p in self.pieces if len(p) > 1)

    @cached_property
    def other_lone(self) -> list[str]:
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        return [c for c in "\t\x0b\x0c" if c not in joined]

    @cached_property
    def neighbours(self) -> set[str]:
        """Every two characters that stand next to each other in a piece."""
        return {a + b for p in self.pieces for a, b in zip(p, p[1:])}

    @cached_property
    def scores(self) -> dict[str, float]:
        return {p: score for p, (score, _) in self.pieces.items()}

    def parts(self, unit: str) -> list[str]:
        """The unit cut between all neighbours that no piece joins, which no merge can cross."""
        joined = self.neighbours
        cuts = [i for i, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in joined]
        return [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)])] if cuts else [unit]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, s, i) for p, (s, i) in self.pieces.items()], "piece string, score double, id int")

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def merged(self, unit: str) -> list[int]:
        """Ids of a unit by merges, best score first, leftmost first among equals."""
        return self._looped(unit) if len(unit) <= _LONGEST_LOOP else self._queued(unit)

    def _ids(self, parts: list[str]) -> list[int]:
        ids: list[int] = []
        for part in parts:
            known = self.pieces.get(part)
            ids += [known[1]] if known else self.bytes_of(part)
        return ids

    def _looped(self, unit: str) -> list[int]:
        score, none = self.scores.get, -math.inf
        parts = list(unit)
        joins = [*map(score, map(add, unit, unit[1:]), repeat(none))]
        while joins and (best := max(joins)) != none:
            at = joins.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at < len(joins):
                joins[at] = score(parts[at] + parts[at + 1], none)
            if at:
                joins[at - 1] = score(parts[at - 1] + parts[at], none)
        return self._ids(parts)

    def _queued(self, unit: str) -> list[int]:
        parts, after, before = list(unit), [*range(1, len(unit)), -1], [*range(-1, len(unit) - 1)]
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and (right := after[left]) >= 0:
                known = self.pieces.get(text := parts[left] + parts[right])
                if known:
                    heapq.heappush(queue, (-known[0], left, text))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, left, text = heapq.heappop(queue)
            right = after[left]
            if not parts[left] or right < 0 or parts[left] + parts[right] != text:
                continue  # one of both has been merged meanwhile
            parts[left], parts[right] = text, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return self._ids(list(filter(None, parts)))


def prepared(text: str) -> str:
    """White space becomes a visible mark, and one stands before the text."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def unit_counts(docs: DataFrame, model: PieceModel, text_col: str) -> DataFrame:
    """word, n of all units of the corpus; counted before they are shuffled."""
    text = F.col(text_col)
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    units = F.regexp_extract_all(F.when(text != "", marked), F.lit(model.unit_pattern), F.lit(0))
    return docs.select(F.explode(units).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word, edges: every substring of a word that is a piece, as structs (start, end, score, id)."""
    n = F.char_length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda size: F.struct(
            i.alias("start"), (i + size).alias("end"), F.substring(F.col("word"), i + 1, size).alias("piece")))))
    edges = words.where("word <> ''").select("word", F.explode(spans).alias("e")).select("word", "e.*")
    known = edges.join(F.broadcast(pieces), "piece", "left")
    edge = F.when(F.col("id").isNotNull(), F.struct("start", "end", "score", "id"))
    # collect_list leaves out the substrings that are no piece; a word keeps its row even without any.
    return known.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def _path_ids(bounds: Column, byte_ids: Column) -> Column:
    """Ids along a path of boundaries; a character that is no piece becomes its bytes."""
    def of(start: Column, i: Column) -> Column:
        end = F.get(bounds, i + 1)
        on = F.filter("edges", lambda e: (e["start"] == start) & (e["end"] == end))
        char = F.hex(F.encode(F.substring(F.col("word"), start + 1, end - start), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(0), F.floor(F.length(char) / 2).cast("int") - 1), lambda b: F.get(
            byte_ids, F.conv(F.substring(char, b * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return F.when(F.size(on) > 0, F.array(F.get(on, F.lit(0))["id"])).otherwise(raw)

    return F.flatten(F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), of))


def fold_merges(lattices: DataFrame, byte_ids: tuple[int, ...]) -> DataFrame:
    """word, ids by merges: a fold over the boundaries between pieces, one of which goes per step."""
    n = F.char_length("word")

    def step(bounds: Column, _: Column) -> Column:
        def candidate(e: Column) -> Column:
            at = F.array_position(bounds, e["start"]).cast("int")
            joins = (at > 0) & (F.get(bounds, at + 1) == e["end"])
            return F.when(joins, F.struct(e["score"].alias("score"), (-e["start"]).alias("left"),
                                          F.get(bounds, at).alias("middle")))
        best = F.array_max(F.transform("edges", candidate))["middle"]
        return F.when(best.isNull(), bounds).otherwise(F.filter(bounds, lambda b: b != best))

    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    bounds = F.aggregate(steps, F.sequence(F.lit(0), n), step)
    table = F.array(*map(F.lit, byte_ids))
    return lattices.withColumn("_bounds", bounds).select("word", _path_ids(F.col("_bounds"), table).alias("ids"))


def fold_viterbi(lattices: DataFrame, byte_ids: tuple[int, ...], unknown: float = -1e6) -> DataFrame:
    """word, ids with the best sum of scores; a character that is no piece counts ``unknown``. Ties: the longer last piece."""
    n = F.char_length("word")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("bounds")))

    def step(best: Column, end: Column) -> Column:
        def through(e: Column) -> Column:
            prior = F.get(best, e["start"])
            return F.struct((prior["score"] + e["score"]).alias("score"), (-e["start"]).alias("near"),
                            F.concat(prior["bounds"], F.array(end)).alias("bounds"))
        lone = F.get(best, end - 1)
        other = F.struct((lone["score"] + unknown).alias("score"), (1 - end).alias("near"),
                         F.concat(lone["bounds"], F.array(end)).alias("bounds"))
        ending = F.transform(F.filter("edges", lambda e: e["end"] == end), through)
        top = F.array_max(F.concat(ending, F.array(other)))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["bounds"].alias("bounds"))))

    states = F.aggregate(F.sequence(F.lit(1), n), start, step)
    table = F.array(*map(F.lit, byte_ids))
    return lattices.withColumn("_bounds", F.get(states, n)["bounds"]).select(
        "word", _path_ids(F.col("_bounds"), table).alias("ids"))


def encoded_units(docs: DataFrame, model: PieceModel, text_col: str = "text", share: float = 1 / 200_000) -> DataFrame:
    """word, ids of every unit with at least ``share`` of all units: at most 1 / share rows."""
    counts = stored(unit_counts(docs, model, text_col), "unit_counts")
    least = counts.agg(F.sum("n")).scalar() * share
    frequent = counts.where((F.col("n") >= least) & (F.char_length("word") <= _LONGEST_UNIT)).select("word")
    return fold_merges(lattice(frequent, model.table(docs.sparkSession), model.longest), model.byte_ids)


class _Memo(dict):
    """Remembers what ``compute`` gives for short keys. When it is full it becomes the older half of the memory, from which
    keys in use come back; what is forgotten is computed again, so no result depends on it."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= _LONGEST_UNIT:
            if len(self) >= _MEMO:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


_encoders: dict[str, Callable[[str], bytes]] = {}


def worker_encoder(run: str, words: dict[str, bytes], model: PieceModel) -> Callable[[str], bytes]:
    """``text_encoder`` of the newest ``run``, kept by the worker process, so its memos serve all tasks of the process."""
    if run not in _encoders:
        _encoders.clear()
        _encoders[run] = text_encoder(words, model)
    return _encoders[run]


def text_encoder(words: dict[str, bytes], model: PieceModel) -> Callable[[str], bytes]:
    """Text to its ids as 32-bit integers; ``words`` holds those of units that are known."""
    pattern = re.compile(model.unit_pattern)
    parts = _Memo(lambda part: array("i", model.merged(part)).tobytes())

    def unit(text: str) -> bytes:
        return words.get(text) or b"".join(map(parts.__getitem__, model.parts(text)))

    # A word between spaces is the unit with a mark before it; one that begins with a line break goes by the pattern.
    by_word = _Memo(lambda word: b"".join(map(unit, pattern.findall(word))) if word[:1] == "\n" else unit(SPACE + word))
    simple, others = model.lone_newline, model.other_lone

    def encode(text: str) -> bytes:
        if simple and "  " not in text and text[:1] != " " and SPACE not in text and not any(c in text for c in others):
            # Line breaks are units of their own, so a space put before them only ends the word; see ``by_word``.
            spaced = text.replace("\n", " \n")
            return b"".join(map(by_word.__getitem__, spaced.split(" "))) if text else b""
        return b"".join(map(unit, pattern.findall(prepared(text))))

    return encode


Batches = Iterator[pa.RecordBatch]


def _encoding(docs: DataFrame, model: PieceModel, text_col: str, keep: tuple[str, ...],
              share: float) -> Callable[[Batches], Batches]:
    """Batches of doc_id, _text and ``keep`` to batches of doc_id, ids and ``keep``."""
    units = stored(encoded_units(docs, model, text_col, share), "unit_ids")
    known = {r["word"]: np.array(r["ids"], np.int32).tobytes() for r in units.toLocalIterator()}  # at most 1 / share rows
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, known, model))

    def run(batches: Batches) -> Batches:
        encode = worker_encoder(*shared.value)

        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                part = batch.slice(begin, _ROWS)
                coded = [encode(t or "") for t in part["_text"].to_pylist()]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, *(part[c] for c in keep)],
                                                 names=["doc_id", "ids", *keep])

    return run


def _decoding(spark: SparkSession, model: PieceModel, keep: tuple[str, ...]) -> Callable[[Batches], Batches]:
    """Batches of doc_id, ids and ``keep`` to the same with the text."""
    joined = np.frombuffer(b"".join(model.texts), np.uint8)
    ends = np.cumsum([0, *map(len, model.texts)])
    shared = spark.sparkContext.broadcast((joined, ends[:-1], np.diff(ends)))

    def run(batches: Batches) -> Batches:
        raw, starts, sizes = shared.value
        for part in (batch.slice(at, _DECODED) for batch in batches for at in range(0, batch.num_rows, _DECODED)):
            column = part["ids"]
            ids = column.flatten().to_numpy(zero_copy_only=False)
            lengths = sizes[ids]
            ends = np.cumsum(lengths)
            # Byte k of the result lies at its piece's start plus its place inside the piece.
            body = raw[np.repeat(starts[ids] - ends + lengths, lengths) + np.arange(lengths.sum())].tobytes()
            counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            decoded = [body[b:e].decode("utf-8", "replace").removeprefix(" ") for b, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], column, pa.array(decoded, pa.string()), *(part[c] for c in keep)],
                names=["doc_id", "ids", "text", *keep])

    return run


def _schema(df: DataFrame, id_col: str, columns: tuple[str, ...], keep: tuple[str, ...]) -> str:
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]
    return ", ".join([f"doc_id {df.schema[id_col].dataType.simpleString()}", *columns, *kinds])


def encode_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text",
                     keep: tuple[str, ...] = (), share: float = 1 / 200_000) -> DataFrame:
    """doc_id, ids (array of int) of every row, with the columns named in ``keep``.

    A null text counts as empty and has no ids. Characters that are no piece become the ids of their UTF-8 bytes.
    Rows are independent: repeated rows and null ids need no care.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    return rows.mapInArrow(_encoding(docs, model, text_col, keep, share), _schema(docs, id_col, ("ids array<int>",), keep))


def decode_documents(encoded: DataFrame, model: PieceModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, text of every row; bytes that are no UTF-8 become the replacement character."""
    return encoded.select("doc_id", "ids", *keep).mapInArrow(
        _decoding(encoded.sparkSession, model, keep), _schema(encoded, "doc_id", ("ids array<int>", "text string"), keep))


def round_trip_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text",
                         keep: tuple[str, ...] = (), share: float = 1 / 200_000) -> DataFrame:
    """``decode_documents`` of ``encode_documents`` in one worker process per task, which passes on the ids itself."""
    encode = _encoding(docs, model, text_col, keep, share)
    decode = _decoding(docs.sparkSession, model, keep)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    return rows.mapInArrow(lambda batches: decode(encode(batches)),
                           _schema(docs, id_col, ("ids array<int>", "text string"), keep))
