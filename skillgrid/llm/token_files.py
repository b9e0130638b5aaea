"""Token ids in files of wavelet matrices, one Parquet file per shard.

Documents are range-partitioned by id and sorted, so a shard holds consecutive ids and its file is written by one task
with Spark's writer (any file system, and a lost task is repeated cleanly). A shard is a list of blocks; a block holds whole
documents, about ``block_tokens`` ids, as a wavelet matrix: one bit-plane per bit of an id, from the highest, each plane
followed by a stable partition of the ids by that bit. With counts of ones at fixed steps (rank), the planes give the id
at a place, the number of occurrences of an id before a place, and all places of an id, without decoding the block.

Words repeat, so a task tells the units between ASCII white space of some megabytes of text apart and hands each distinct
one to the tokenizer once per memo of bounded size. This is exact for tokenizers that cut at white space and drop it.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

_STEP = 4096  # bits between two stored counts of ones
_CHUNK = 16 << 20  # bytes of text whose units are told apart together
_MEMO = 64 << 20  # bytes of units and ids
_IDS = pa.list_(pa.uint32())
# Latin letters that stay as they are under NFC. ASCII marks after them are a run of their own to the tokenizer.
_LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº")


@dataclass
class WaveletMatrix:
    length: int
    bits: int
    zeros: list[int]      # ids with a 0 bit, per plane
    planes: list[bytes]   # packed bits, highest bit first
    ones: list[np.ndarray]  # ones before every _STEP bits of a plane

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        current, zeros, planes, ones = ids.astype(np.uint32 if bits > 16 else np.uint16), [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (current & (1 << level)) != 0
            packed = np.packbits(bit)
            planes.append(packed.tobytes())
            sums = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), _STEP // 8), dtype=np.int64) if len(
                packed) else np.zeros(0, np.int64)
            ones.append(np.concatenate(([0], np.cumsum(sums))))
            left = current[~bit]
            zeros.append(len(left))
            current = np.concatenate((left, current[bit]))
        return cls(len(ids), bits, zeros, planes, ones)

    def _plane(self, level: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Bits of a plane; ``begin`` is a multiple of 8."""
        end = self.length if end is None else end
        packed = np.frombuffer(self.planes[level], np.uint8, -(-end // 8) - begin // 8, begin // 8)
        return np.unpackbits(packed, count=end - begin).astype(bool)

    def _rank(self, level: int, place: int) -> int:
        begin = place // _STEP * _STEP
        return int(self.ones[level][place // _STEP]) + int(self._plane(level, begin, place).sum())

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.length:
            raise IndexError(place)
        value = 0
        for level in range(self.bits):
            before = self._rank(level, place)
            if self._rank(level, place + 1) > before:
                value |= 1 << (self.bits - 1 - level)
                place = self.zeros[level] + before
            else:
                place -= before
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first ``end`` ids stand after the last partition."""
        begin = 0
        for level in range(self.bits):
            a, b = self._rank(level, begin), self._rank(level, end)
            if token >> (self.bits - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, token: int, end: int | None = None) -> int:
        if token >> self.bits:
            return 0
        begin, end = self._range(token, self.length if end is None else end)
        return end - begin

    def places(self, token: int) -> np.ndarray:
        if token >> self.bits:
            return np.zeros(0, np.int64)
        found = np.arange(*self._range(token, self.length))
        for level in range(self.bits - 1, -1, -1):
            bit = self._plane(level)
            if token >> (self.bits - 1 - level) & 1:
                found = np.flatnonzero(bit)[found - self.zeros[level]]
            else:
                found = np.flatnonzero(~bit)[found]
        return found

    def decode(self) -> np.ndarray:
        current = np.zeros(self.length, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            bit = self._plane(level)
            above = np.empty_like(current)
            above[~bit] = current[:self.zeros[level]]
            above[bit] = current[self.zeros[level]:] | (1 << (self.bits - 1 - level))
            current = above
        return current


class _Memo:
    """Ids of distinct units. Those not met lately go to ``learn``; forgets all when it holds over ``_MEMO`` bytes."""

    def __init__(self, learn: Callable[[list[str]], pa.ListArray]):
        self._learn = learn
        self._forget()

    def _forget(self) -> None:
        self._units, self._ids = pa.array([""]), pa.array([[]], _IDS)

    def ids(self, units: pa.Array) -> pa.ListArray:
        if self._units.nbytes + self._ids.nbytes > _MEMO:
            self._forget()
        places = pc.fill_null(pc.index_in(units, value_set=self._units), -1).to_numpy(zero_copy_only=False).copy()
        missing = places < 0
        if missing.any():
            new = units.filter(pa.array(missing))
            places[missing] = np.arange(len(self._units), len(self._units) + len(new))
            self._units = pa.concat_arrays([self._units, new])
            self._ids = pa.concat_arrays([self._ids, self._learn(new.to_pylist())])
        return self._ids.take(pa.array(places))


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> Callable[[pa.Array | list[str | None]], Iterator[bytes]]:
    """Encode texts with the tokenizer file at ``path``: little-endian unsigned 32-bit ids, the end id last.

    Kept by the worker process, so its memos serve all tasks that the process runs.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    # Lower-case Latin letters between spaces pass the normaliser and the word pattern as they are, so these may rest.
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    ends_word[[i for t, i in tokenizer.get_vocab(False).items() if t.endswith("</w>")]] = True

    def library(texts: list[str], by: Tokenizer = tokenizer) -> list[list[int]]:
        return [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_words(words: list[str]) -> pa.ListArray:
        """Words of plain letters go to the tokenizer in lines; each ends with its only word-end token."""
        lines = [words[i:i + 200] for i in range(0, len(words), 200)]
        found = [np.array(ids, np.uint32) for ids in library([" ".join(line) for line in lines], bare)]
        flat = np.concatenate(found)
        cuts = np.concatenate(([0], np.flatnonzero(ends_word[flat]) + 1)).astype(np.int32)
        per_line = np.cumsum([len(line) for line in lines])
        assert len(cuts) == len(words) + 1 and (cuts[per_line] == np.cumsum([len(f) for f in found])).all(), \
            "the tokenizer joined words"
        return pa.ListArray.from_arrays(cuts, flat)

    plain, others = _Memo(learn_words), _Memo(lambda units: pa.array(library(units), _IDS))

    def encode_chunk(texts: pa.Array) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(texts)
        units = split.flatten().dictionary_encode()
        distinct = units.dictionary
        # Letters, and marks after them, which are tokens of their own. Any other unit goes to the tokenizer as it is.
        words, marks = pc.ascii_rtrim(distinct, string.punctuation), pc.utf8_ltrim(distinct, _LETTERS)
        plainly = pc.equal(pc.add(pc.binary_length(words), pc.binary_length(marks)), pc.binary_length(distinct))
        words = pc.if_else(plainly, pc.utf8_lower(words), "").dictionary_encode()
        marks = pc.if_else(plainly, marks, distinct).dictionary_encode()
        # Both parts of a unit stand side by side, so every second offset is one of a unit.
        parts = pa.concat_arrays([plain.ids(words.dictionary), others.ids(marks.dictionary)])
        order = np.empty(2 * len(distinct), np.int32)
        order[::2] = words.indices.to_numpy()
        order[1::2] = marks.indices.to_numpy() + len(words.dictionary)
        parts = parts.take(pa.array(order))
        ids = pa.ListArray.from_arrays(pa.array(parts.offsets.to_numpy()[::2]), parts.values).take(units.indices)
        ends = ids.offsets.to_numpy()[np.cumsum(split.value_lengths().to_numpy())]
        raw = np.insert(ids.values.to_numpy(), ends, end_id).astype("<u4").tobytes()
        begin = 0
        for end in (4 * (ends.astype(np.int64) + np.arange(1, len(ends) + 1))).tolist():
            yield raw[begin:end]
            begin = end

    def encode(texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        begins = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // _CHUNK, prepend=-1)).tolist()
        for begin, end in zip(begins, [*begins[1:], len(texts)]):
            yield from encode_chunk(texts.slice(begin, end - begin).cast(pa.string()))

    return encode


_BLOCK = ("shard int, block int, n_tokens bigint, bits int, zeros array<bigint>, planes array<binary>, "
          "ones array<binary>, doc_ids array<{kind}>, doc_tokens array<bigint>")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, bits: int, id_col: str = "doc_id",
                      text_col: str = "text", shards: int | None = None, block_tokens: int = 1 << 18) -> None:
    """Encode every text and write the shards in ascending order of ids under ``path``.

    Null texts count as empty: their only id is the end id. Null ids come first. Repeated rows are written each. An
    empty table writes no blocks.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, block = word_encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        ids, sizes, held, waiting = [], [], [], 0

        def full() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"), bits)
            values = [shard, block, m.length, bits, m.zeros, m.planes, [o.astype("<i8").tobytes() for o in m.ones],
                      ids, sizes]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            key = batch["doc_id"].type
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()),
                     pa.list_(pa.binary()), pa.list_(key), pa.list_(pa.int64())]
            names = ["shard", "block", "n_tokens", "bits", "zeros", "planes", "ones", "doc_ids", "doc_tokens"]
            for doc_id, coded in zip(batch["doc_id"].to_pylist(), encode(batch["text"])):
                ids.append(doc_id)
                sizes.append(len(coded) // 4)
                held.append(coded)
                waiting += sizes[-1]
                if waiting >= block_tokens:
                    yield full()
                    ids, sizes, held, waiting, block = [], [], [], 0, block + 1
        if ids:
            yield full()

    ordered.mapInArrow(run, _BLOCK.format(kind=kind)).write.option("compression", "zstd").parquet(path)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["bits"], row["zeros"], row["planes"],
                         [np.frombuffer(o, "<i8") for o in row["ones"]])


def _from_blocks(blocks: DataFrame, each: Callable[[dict, WaveletMatrix], dict[str, list]], schema: str) -> DataFrame:
    """Open every block and emit the columns that ``each`` gives for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict(each(row, _matrix(row)))

    return blocks.mapInArrow(run, schema)


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block and the number of ids before the block: within its shard, and all shards before (one row each)."""
    sizes = blocks.select("shard", "block", "n_tokens")
    per_shard = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("_all"))

    def before(column: str, window) -> F.Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    shards = per_shard.select("shard", before("_all", Window.partitionBy().orderBy("shard")).alias("_shard_start"))
    inside = sizes.select("shard", "block", before("n_tokens", Window.partitionBy("shard").orderBy("block")).alias("_in"))
    return inside.join(shards, "shard").select("shard", "block", (F.col("_shard_start") + F.col("_in")).alias("start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decoded_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the planes."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def each(row: dict, matrix: WaveletMatrix) -> dict[str, list]:
        raw = memoryview(matrix.decode().astype("<u4").tobytes())
        ends = np.cumsum(row["doc_tokens"])
        begins = ends - row["doc_tokens"]
        n = len(begins)
        return {"doc_id": row["doc_ids"], "shard": pa.array([row["shard"]] * n, pa.int32()),
                "block": pa.array([row["block"]] * n, pa.int32()), "inside": begins, "n_tokens": row["doc_tokens"],
                "ids_crc32": [zlib.crc32(raw[4 * b:4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]}

    found = _from_blocks(blocks, each, f"doc_id {kind}, shard int, block int, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(block_starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(blocks: DataFrame, token: int) -> DataFrame:
    """shard, n: how often each shard holds ``token``, by rank alone."""
    found = _from_blocks(blocks, lambda row, m: {"shard": pa.array([row["shard"]], pa.int32()), "n": [m.count(token)]},
                         "shard int, n bigint")
    return found.groupBy("shard").agg(F.sum("n").alias("n"))


def token_places(blocks: DataFrame, token: int) -> DataFrame:
    """place: every place of ``token`` among the ids of all shards."""
    def each(row: dict, m: WaveletMatrix) -> dict[str, list]:
        inside = m.places(token)
        return {"shard": pa.array([row["shard"]] * len(inside), pa.int32()),
                "block": pa.array([row["block"]] * len(inside), pa.int32()), "inside": pa.array(inside, pa.int64())}

    found = _from_blocks(blocks, each, "shard int, block int, inside bigint")
    return found.join(block_starts(blocks), ["shard", "block"]).select((F.col("start") + F.col("inside")).alias("place"))
