"""N-gram Jaccard join with PartEnum signatures, and the components of its links.

Sets (distinct word shingles) are put into bands of size, so that linked sets lie in the same or in adjacent bands. For
the larger band, the similarity bounds the number of differing shingles by k. The shingle domain is cut into first-level
partitions by hash, each into a few second-level ones. Linked sets differ in at most k shingles, so some first-level
partition has at most one differing shingle, and there all but one of the second-level partitions are equal: enumerating
these subsets, linked sets share at least one signature (band, partition, subset, content).

A few more partitions than needed (slack) allow exactness without unselective signatures: a set leaves out its signatures
of fewer shingles than some number, the largest (up to a bound) at which they lie in no more partitions than the slack.
Two linked sets agree in more partitions than the slack. A common signature has the same shingles in both, so the set
with the larger number decides, and one of their common signatures remains.

Signatures (hashes) are shuffled, never shingles. Copies within a task give their signatures once. Inside a bucket, sets
are compared along a chain in random order first; only pairs whose sets are not connected by then are compared afterwards,
in tiles, so a group of near copies costs a few comparisons per member and no link between different texts is lost.
Tiles compare outlines (signed counts of shingles in few cells), the pairs they leave are compared by sketches (a byte per
shingle); both bound the differing shingles from below. The sets of the pairs that remain are read again from the texts
and decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from skillgrid.llm.common import free_name, salted_lookup, without_rows
from skillgrid.llm.components import components
from skillgrid.session import stored

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TRUE = np.ones(1, bool)
_TEXTS = 256  # texts that are hashed together


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of many texts at once.

    The hash of a word is the difference of two prefix sums of byte values times powers of an odd number, divided by the
    power at its start, all modulo 2 ** 64; so words need no loop. A batch of texts is one array of bytes.
    """

    _BASE = 0x9E3779B97F4A7C15
    _INVERSE = pow(_BASE, -1, 1 << 64)

    def __init__(self, words: int):
        self.words = words
        self.values = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)  # one 64-bit number per byte
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 2 * len(self.powers))
            ones = np.ones(1, np.uint64)
            self.powers = np.cumprod(np.concatenate((ones, np.full(size - 1, self._BASE, np.uint64))), dtype=np.uint64)
            self.inverses = np.cumprod(np.concatenate((ones, np.full(size - 1, self._INVERSE, np.uint64))), dtype=np.uint64)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct 64-bit shingles of each text; a text with fewer words is one shingle, without words none."""
        joined = b" ".join([b"", *(t or b"" for t in texts), b""]).lower()  # bytes.lower touches A-Z only
        raw = np.frombuffer(joined, np.uint8)
        self._grow(len(raw) + 1)
        blank = self.space[raw]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # starts and ends of words in turn
        starts, ends = edges[0::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[raw] * self.powers[:len(raw)], dtype=np.uint64)))
        hashes = _mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
        n = self.words
        rolled = np.full(max(len(hashes) - n + 1, 0), n, np.uint64)
        for j in range(n):
            rolled = _mixed(rolled * _ODD + hashes[j:j + len(rolled)])
        found = []
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end - begin >= n:
                own = np.sort(rolled[begin:end - n + 1])
                found.append(own[np.concatenate((_TRUE, own[1:] != own[:-1]))])
            else:
                found.append(self._short(hashes[begin:end]))
        return found

    @staticmethod
    def _short(hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.empty(0, np.uint64)
        rolled = np.full(1, len(hashes), np.uint64)
        for h in hashes:
            rolled = _mixed(rolled * _ODD + h)
        return rolled


def sketch(shingles: np.ndarray) -> bytes:
    """One byte per cell of the shingle domain, with about as many cells (a power of two) as shingles.

    A byte is the exclusive or of its shingles' checksums, so two cells with different bytes differ in a shingle at
    least, and the sketch for half as many cells is the exclusive or of its halves.
    """
    cells = 1 << (len(shingles).bit_length() - 1)
    out = np.zeros(cells, np.uint8)
    np.bitwise_xor.at(out, (shingles & np.uint64(cells - 1)).astype(np.int64), (shingles >> np.uint64(56)).astype(np.uint8))
    return out.tobytes()


def outline(shingles: np.ndarray) -> bytes:
    """One signed byte per cell: its shingles counted as +1 or -1, with a cell for 8 to 16 shingles, and 64 cells at least.

    A differing shingle changes one cell by one, so the sum of all changes is a lower bound of the number of differing
    shingles. Clipping to a byte and adding the halves for half as many cells only bring two outlines closer.
    """
    size = len(shingles).bit_length() - 1
    cells = 1 << min(size, max(6, size - 3))
    sign = 1 - 2 * ((shingles >> np.uint64(55)) & np.uint64(1)).astype(np.int64)
    counts = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), weights=sign, minlength=cells)
    return np.clip(counts, -127, 127).astype(np.int8).tobytes()


def fewest_differences(left: bytes, right: bytes) -> int:
    """A lower bound of the number of differing shingles."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.count_nonzero(x != y))


def set_name(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "big", signed=True)


@dataclass(frozen=True)
class JaccardSettings:
    words: int = 5
    similar: int = 80   # linked: whole * intersection >= similar * union
    whole: int = 100
    parts: int = 3      # second-level partitions of each first-level one
    few: int = 3        # a signature of fewer shingles is not selective and left out, if the slack allows it
    slack: int = 8      # one partition more per so many
    tile: int = 1024    # sets of a bucket that a task compares with each other, or with as many more
    looked_back: int = 24  # signatures of a set that are looked at to compare a pair once only


@dataclass(frozen=True)
class _Plan:
    """Partitions of one band."""

    partitions: int
    parts: int
    slack: int
    salts: np.ndarray


class PartEnum:
    def __init__(self, settings: JaccardSettings):
        self.s = settings
        self._tops: list[int] = []
        self._plans: dict[int, _Plan] = {}

    def band(self, size: int) -> int:
        while not self._tops or self._tops[-1] < size:
            low = self._tops[-1] + 1 if self._tops else 1
            self._tops.append(max(low, low * self.s.whole // self.s.similar))
        return int(np.searchsorted(self._tops, size))

    def top(self, band: int) -> int:
        while len(self._tops) <= band:
            self.band(self._tops[-1] + 1 if self._tops else 1)
        return self._tops[band]

    def plan(self, band: int) -> _Plan:
        if band not in self._plans:
            most = (self.s.whole - self.s.similar) * 2 * self.top(band) // (self.s.whole + self.s.similar)
            parts, needed = (self.s.parts, most // 2 + 1) if most else (1, 1)
            slack = needed // self.s.slack
            count = needed + slack
            seeds = np.arange(count * parts, dtype=np.uint64) + np.uint64(band + 1) * np.uint64(1 << 32)
            self._plans[band] = _Plan(count, parts, slack, _mixed(seeds * _ODD).reshape(count, parts))
        return self._plans[band]

    def of_band(self, shingles: np.ndarray, band: int) -> np.ndarray:
        p = self.plan(band)
        cells = p.partitions * p.parts
        cell = (shingles % np.uint64(cells)).astype(np.int64)
        content = np.zeros(cells, np.uint64)
        np.add.at(content, cell, _mixed(shingles + _ODD))
        content = content.reshape(p.partitions, p.parts)
        sizes = np.bincount(cell, minlength=cells).reshape(p.partitions, p.parts)
        if p.parts > 1:  # all but one of the second-level partitions
            content = content.sum(axis=1, keepdims=True, dtype=np.uint64) - content
            sizes = sizes.sum(axis=1, keepdims=True) - sizes
        signatures = _mixed(content ^ p.salts)
        least = np.sort(sizes.min(axis=1))  # of each partition
        allowed = min(self.s.few, int(least[p.slack]))  # at most ``slack`` partitions have smaller ones
        return signatures[sizes >= allowed]

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Of the set's own band, and of the next one if a larger partner can lie there."""
        own = self.band(len(shingles))
        found = [self.of_band(shingles, own)]
        if len(shingles) * self.s.whole // self.s.similar > self.top(own):
            found.append(self.of_band(shingles, own + 1))
        return np.concatenate(found).view(np.int64)


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.encode(F.col(text_col), "UTF-8").alias("_body"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, _TEXTS):
            yield batch.slice(begin, _TEXTS)


def _named_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_id, _n (size of the set), _node (its name; null for an empty set), _sketch and _outline (once per set and task)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for part in _parts(batches):
            sets = shingler.sets(part["_body"].to_pylist())
            nodes = [set_name(s) if len(s) else None for s in sets]
            sketches, outlines = [], []
            for s, node in zip(sets, nodes):
                new = node is not None and node not in seen
                sketches.append(sketch(s) if new else None)
                outlines.append(outline(s) if new else None)
                seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [part["_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(sketches, pa.binary()), pa.array(outlines, pa.binary())],
                names=["_id", "_n", "_node", "_sketch", "_outline"])

    rows = _bodies(docs, id_col, text_col)
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_n", T.LongType()),
                           T.StructField("_node", T.LongType()), T.StructField("_sketch", T.BinaryType()),
                           T.StructField("_outline", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _signed(docs: DataFrame, id_col: str, text_col: str, settings: JaccardSettings) -> DataFrame:
    """_sig, _node of every non-empty set; a set that a task has seen before gives nothing more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, scheme, seen = Shingler(settings.words), PartEnum(settings), set()
        for part in _parts(batches):
            sigs, nodes = [np.empty(0, np.int64)], []
            for shingles in shingler.sets(part["_body"].to_pylist()):
                if len(shingles) and (name := set_name(shingles)) not in seen:
                    seen.add(name)
                    sigs.append(scheme.signatures(shingles))
                    nodes.append(name)
            names = np.repeat(np.array(nodes, np.int64), [len(s) for s in sigs[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(names)], names=["_sig", "_node"])

    return _bodies(docs, id_col, text_col).select("_body").mapInArrow(run, "_sig bigint, _node bigint")


def _sets_of(docs: DataFrame, named: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_node and _set (bytes of the sorted shingles) of the sets in ``pairs``, each read from one document that has it."""
    nodes = pairs.select(F.col("_a").alias("_node")).unionByName(pairs.select(F.col("_b").alias("_node"))).distinct()
    holders = stored(named.join(nodes, "_node").groupBy("_node").agg(F.min("_id").alias("_holder")).select(
        "_holder").distinct(), "holders")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for part in _parts(batches):
            sets = [s for s in shingler.sets(part["_body"].to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["_node", "_set"])

    bodies, held = _bodies(docs, id_col, text_col).alias("d"), holders.alias("h")
    wanted = bodies.join(held, F.col("d._id").eqNullSafe(F.col("h._holder")), "left_semi")
    # Repeated ids can bring a set twice; the same bytes, so any row will do.
    return stored(wanted.select("_body").mapInArrow(run, "_node bigint, _set binary").dropDuplicates(["_node"]), "sets")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    left = table.select(F.col("_node").alias("_a"), F.col(column).alias("_left"))
    right = table.select(F.col("_node").alias("_b"), F.col(column).alias("_right"))
    return pairs.join(left, "_a").join(right, "_b").select("_a", "_b", "_left", "_right")


def _kept_pairs(met: DataFrame, keep: Callable[[bytes, bytes], bool], label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [keep(a, b) for a, b in zip(batch["_left"].to_pylist(), batch["_right"].to_pylist())]
            yield batch.select(["_a", "_b"]).filter(pa.array(chosen, pa.bool_()))

    return stored(met.mapInArrow(run, "_a bigint, _b bigint"), label)


def _sketches(named: DataFrame) -> DataFrame:
    """_node, _n, _outline, and _sketch behind eight bytes that hold the size of the set."""
    sized = F.concat(F.unhex(F.lpad(F.hex("_n"), 16, "0")), F.col("_sketch"))
    return named.where("_sketch IS NOT NULL").select("_node", "_n", sized.alias("_sketch"), "_outline").dropDuplicates(
        ["_node"])


def _linked(docs: DataFrame, named: DataFrame, pairs: DataFrame, settings: JaccardSettings, id_col: str,
            text_col: str) -> DataFrame:
    """The pairs (_a, _b) whose sets are similar enough."""
    def true(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        small, large = (x, y) if len(x) < len(y) else (y, x)
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[place] == small).sum())
        return settings.whole * both >= settings.similar * (len(x) + len(y) - both)

    sets = _sets_of(docs, named, pairs, id_col, text_col, settings.words)
    return _kept_pairs(_with_both(pairs, sets, "_set"), true, "jaccard_links")


def _possible(settings: JaccardSettings) -> Callable[[bytes, bytes], bool]:
    similar, whole = settings.similar, settings.whole

    def possible(a: bytes, b: bytes) -> bool:
        m, n = int.from_bytes(a[:8], "big"), int.from_bytes(b[:8], "big")
        most = (whole - similar) * (m + n) // (whole + similar)
        return abs(m - n) <= most and fewest_differences(a[8:], b[8:]) <= most
    return possible


def tile_pairs(nodes: np.ndarray, parts: np.ndarray, sides: np.ndarray, sizes: np.ndarray, outlines: list[bytes],
               earlier: list[list[int | None]], settings: JaccardSettings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that lie in different components and may be similar: of all rows, or across two sides.

    ``earlier`` holds each set's signatures before the tile's own. A pair that shares one of them meets there as well and
    is left out here; in the smallest signature it shares it is never left out.
    """
    # Missing ones differ from each other and from all signatures.
    left = np.array([[0 if e is None else e for e in row] for row in earlier], np.int64).reshape(len(nodes), -1)
    right = np.array([[1 if e is None else e for e in row] for row in earlier], np.int64).reshape(len(nodes), -1)
    cells = min(map(len, outlines))
    table = np.empty((len(nodes), cells), np.int32)
    for i, o in enumerate(outlines):
        table[i] = np.frombuffer(o, np.int8).reshape(-1, cells).sum(axis=0, dtype=np.int32)
    across, found = len(set(sides.tolist())) > 1, []
    for i in range(len(nodes) - 1):
        other = np.flatnonzero((parts[i + 1:] != parts[i]) & ((sides[i + 1:] != sides[i]) | (not across))) + i + 1
        most = (settings.whole - settings.similar) * (sizes[i] + sizes[other]) // (settings.whole + settings.similar)
        other = other[np.abs(sizes[other] - sizes[i]) <= most]
        if len(other):
            most = (settings.whole - settings.similar) * (sizes[i] + sizes[other]) // (settings.whole + settings.similar)
            other = other[np.abs(table[other] - table[i]).sum(axis=1) <= most]
        if len(other) and left.shape[1]:
            own, theirs = np.sort(left[i]), right[other]
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            other = other[~(own[place] == theirs).any(axis=1)]
        if len(other):
            found.append((np.full(len(other), nodes[i]), nodes[other]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _open_pairs(buckets: DataFrame, outlines: DataFrame, settings: JaccardSettings) -> DataFrame:
    """Possible pairs (_a, _b) between the components of each bucket, by ``outlines`` (_node, _n, _outline).

    A bucket is compared tile by tile: its rows are dealt to tiles by hash, and every two tiles meet in a task of
    their own, so no task holds a whole large bucket and only possible pairs come out. Sets that share many buckets
    are compared in the first of them (as far as the last few signatures of both tell).
    """
    own = Window.partitionBy("_node").orderBy("_sig")
    before = F.array(*[F.lag("_sig", k).over(own) for k in range(1, settings.looked_back + 1)])
    tiles = F.ceil(F.count("*").over(Window.partitionBy("_sig")) / settings.tile).cast("int")
    dealt = buckets.withColumn("_tiles", tiles).withColumn("_side", F.pmod(F.xxhash64("_node"), "_tiles").cast("int"))
    met = dealt.withColumn("_before", before).join(outlines, "_node").withColumn(
        "_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    keys = ["_sig", "_one", "_two"]
    met = met.select("_sig", F.least("_side", "_with").alias("_one"), F.greatest("_side", "_with").alias("_two"), "_side",
                     "_node", "_c", "_n", "_outline", "_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def compared() -> pa.RecordBatch:
            a, b = tile_pairs(np.array([r[4] for r in rows]), np.array([r[5] for r in rows]),
                              np.array([r[3] for r in rows]), np.array([r[6] for r in rows]), [r[7] for r in rows],
                              [r[8] for r in rows], settings)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["_a", "_b"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in (*keys, "_side", "_node", "_c", "_n", "_outline", "_before"))):
                if row[:3] != key:
                    if len(rows) > 1:
                        yield compared()
                    key, rows = row[:3], []
                rows.append(row)
        if len(rows) > 1:
            yield compared()

    count = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(count, *keys).sortWithinPartitions(*keys).mapInArrow(run, "_a bigint, _b bigint")


def jaccard_components(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links).

    A text without words, or null, is an empty set and linked with nothing, so its component is its own id. Equal sets are
    linked. A null id is never the smallest: such a row gets the smallest other id of its component, or null. Repeated
    rows get equal answers. Shingles and sets are known by 64-bit hashes. Other columns of ``docs`` are not read.
    """
    named = stored(_named_sets(docs, id_col, text_col, settings.words), "named_sets")
    signed = _signed(docs, id_col, text_col, settings)
    bucket = Window.partitionBy("_sig")
    # Rows of buckets with several sets; buckets of one set end here.
    buckets = stored(signed.withColumns({"_low": F.min("_node").over(bucket), "_high": F.max("_node").over(bucket)}).where(
        "_low <> _high").select("_sig", "_node").distinct(), "buckets")

    def labelled(df: DataFrame, label: DataFrame) -> DataFrame:
        found = label.select(F.col("node").alias("_node"), F.col("component").alias("_l"))
        return df.join(found, "_node", "left").withColumn("_c", F.coalesce("_l", "_node")).drop("_l")

    sketches = stored(_sketches(named.join(buckets.select("_node").distinct(), "_node", "left_semi")), "sketches")

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        ordered = stored(pairs.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), label)
        possible = _kept_pairs(_with_both(ordered, sketches, "_sketch"), _possible(settings), f"{label}_possible")
        return _linked(docs, named, possible, settings, id_col, text_col)

    def still_open(label: DataFrame) -> DataFrame:
        # The only pair of a bucket of two has been compared in the chain.
        rows = labelled(buckets, label).withColumns({
            "_low": F.min("_c").over(bucket), "_high": F.max("_c").over(bucket), "_size": F.count("*").over(bucket)})
        return stored(rows.where("_low <> _high AND _size > 2").select("_sig", "_node", "_c"), "open_buckets")

    # In each bucket a set meets the next one in a random order, which connects most of what is alike.
    order = Window.partitionBy("_sig").orderBy(F.xxhash64("_node"))
    chained = buckets.select(F.col("_node").alias("_a"), F.lag("_node").over(order).alias("_b")).where("_b IS NOT NULL")
    links = linked(chained, "chained")
    # Then the buckets that still hold several components are compared in full; the settled ones have left.
    outlines = sketches.select("_node", "_n", "_outline")
    rest = linked(_open_pairs(still_open(components(links, "_a", "_b")), outlines, settings), "open_pairs")
    label = components(links.unionByName(rest), "_a", "_b")

    grouped = labelled(named.where("_node IS NOT NULL").select("_id", "_n", "_node"), label)
    smallest = grouped.groupBy("_c").agg(F.min("_id").alias("component_id"))
    full = salted_lookup(grouped.withColumn("_h", F.xxhash64("_c")), smallest.withColumn("_h", F.xxhash64("_c")), ["_c"],
                         "_h", ["_id"]).select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), "component_id")
    empty = named.where("_node IS NULL").select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"),
                                                F.col("_id").alias("component_id"))
    return full.unionByName(empty)


def one_per_component(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts: the one with the smallest id (null ids first).

    Texts without words are linked with nothing and stay. Rows are told apart by id and text; repeated rows stay once.
    """
    key = free_name(docs, "_row_key")
    digest = F.xxhash64(F.coalesce(text_col, F.lit("")))
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), digest.alias("h")))
    found = jaccard_components(keyed, settings, key, text_col)
    decided = found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("_stays")).groupBy("doc_id").agg(
        F.bool_or("_stays").alias("_stays"), F.count("*").alias("_rows"))
    decided = stored(decided.select("doc_id.id", "doc_id.h", "_stays", "_rows"), "jaccard_decided")
    return without_rows(docs, decided.select(F.col("id").alias("doc_id"), F.col("h").alias("_h"), "_stays", "_rows"),
                        id_col, digest)
