"""Mixing sources to target weights by cube-method balanced sampling.

A source with target T and size S is taken T / S times: every document as often as the whole part says, and once more
with the fractional part as inclusion probability. Which documents get that once more is a balanced sample: the vector of
probabilities moves along directions in the null space of the balancing constraints (tokens and number of documents)
until each is 0 or 1, so the totals stay what the probabilities promise.

The flight runs in pieces of a stated size (hash of the id inside a source, so a source that holds a third of all rows is
many pieces). Every piece leaves at most two fractions, and those of a source meet in the next round: a few rounds reach
one piece per source whatever its size. There the last fractions land on the combination nearest to the totals.

Documents too large to be moved by the others of their piece are drawn first, and all others together take over their
words. Then the largest undecided document always takes part in a move, together with the next largest and the smallest
one: sizes that differ let it move, so it is decided while many others can still balance it. Two bands of small documents wait: the first holds the words of the largest
document, the second a few of the smallest. Each takes over what the landing before it misses, and flies after it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skillgrid.llm.common import WORD, free_name, salted_lookup
from skillgrid.session import stored

_TINY = 1e-9
_HELD = 8  # small documents that a piece hands on to the next round untouched


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # repeating, over the sources by code point, null last
    share: float = 1.0                            # of all sizes
    cap: float = 3.0                              # a target is at most this many times its source's size
    piece: int = 4096                             # documents that fly together
    reserve: int = 64                             # smallest documents of a source, which fly last
    seed: int = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(rows: DataFrame, settings: MixSettings) -> DataFrame:
    """One row per source: _k, source_size, target, _docs.

    Resharing the excess until no source is above its cap ends where target = min(cap * size, level * weight) for one
    level. The level is found in closed form: in the order of cap * size / weight the capped sources come first.
    The windows run over the sources, one row each, not over documents.
    """
    per = rows.groupBy("_k", "_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_docs"))
    w = F.array(*[F.lit(float(x)) for x in settings.weights])
    by_name = Window.partitionBy().orderBy(F.col("_source").isNull(), F.col("_source"))
    per = per.withColumn("_w", F.get(w, (F.row_number().over(by_name) - 1) % len(settings.weights)))
    per = per.withColumn("_most", settings.cap * F.col("source_size")).withColumn("_ratio", F.col("_most") / F.col("_w"))
    order = Window.partitionBy().orderBy("_ratio", "_k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * settings.share
    level = (total - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    per = per.withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("_w") > F.col("_most"))
    open_level = F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_k", "_level"))).over(whole)["_level"]
    target = F.when(F.col("_capped"), F.col("_most")).otherwise(F.col("_w") * F.coalesce(open_level, F.lit(0.0)))
    return per.withColumn("target", F.least(target, F.col("_most"))).select("_k", "source_size", "target", "_docs")


def _draw(seed: int, doc_id: object, step: int) -> float:
    digest = hashlib.blake2b(f"{seed}:{doc_id}:{step}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0 ** 64


def _direction(sizes: list[int], others: int) -> list[float] | None:
    """A vector that keeps the tokens and the number of the sample, for two or three units, the largest first.

    Two units of nearly one size cannot move a much larger one and keep both; if the ``others`` still to come are too few
    to move it that way, the number gives way to the tokens.
    """
    if len(sizes) == 3:
        a, b, c = sizes
        if a == b == c:
            return [1.0, -1.0, 0.0]
        if a > 4 * b > 0 and 2 * (b - c) < b + c and (b - c) * others < 4 * a:
            return [float(b + c), float(-a), float(-a)]
        return [float(c - b), float(a - c), float(b - a)]
    return [1.0, -1.0] if len(sizes) == 2 and sizes[0] == sizes[1] else None


def fly(ids: list, sizes: list[int], chances: list[float], seed: int) -> tuple[list[float], list[int]]:
    """Move the probabilities until at most two are fractions; also the places of those."""
    p, step, active, low = list(chances), 0, [], set()
    waiting = deque(sorted(range(len(ids)), key=lambda i: (-sizes[i], i)))
    while True:
        while len(active) < 3 and waiting:
            # One of the three is the smallest that waits, the others are the largest.
            if active and not low.intersection(active):
                active.append(waiting.pop())
                low.add(active[-1])
            else:
                active.append(waiting.popleft())
        active.sort(key=lambda i: (-sizes[i], i))
        u = _direction([sizes[i] for i in active], len(waiting))
        if u is None:
            return p, active
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(active, u) if x)
        # Up with the chance that keeps every probability in expectation.
        move = up if _draw(seed, ids[active[0]], step) * (up + down) < down else -down
        step += 1
        for i, x in zip(active, u):
            p[i] += move * x
            if p[i] < _TINY or p[i] > 1 - _TINY:
                p[i] = float(round(p[i]))
        active = [i for i in active if 0.0 < p[i] < 1.0]


def land(sizes: list[int], tokens: float, count: float) -> list[float]:
    """The combination of at most two fractions nearest to the wanted tokens, then to the wanted number."""
    return list(min(itertools.product((0.0, 1.0), repeat=len(sizes)), key=lambda c: (
        abs(sum(s * x for s, x in zip(sizes, c)) - tokens), abs(sum(c) - count))))


def _spread(sizes: list[int], chances: list[float], tokens: float) -> list[float]:
    """Raise or lower probabilities by one factor so that their tokens change by ``tokens``, as far as they can."""
    room = sum(s * ((1 - p) if tokens > 0 else p) for s, p in zip(sizes, chances))
    share = min(1.0, abs(tokens) / room) if room else 0.0
    moved = [p + (1 - p) * share if tokens > 0 else p - p * share for p in chances]
    return [float(round(p)) if p < _TINY or p > 1 - _TINY else p for p in moved]


def draw_giants(ids: list, sizes: list[int], chances: list[float], seed: int) -> tuple[list[float], int]:
    """Decide the documents that moves against the smaller ones would not decide; also how many they are.

    ``sizes`` fall. A document moves at random by steps of the others' sizes, so it needs others whose squares reach
    several times its own. One that lacks them is drawn by its probability, and all smaller documents together take over
    its words; where they have not enough of them, the result that misses less is taken instead.
    """
    p, squares = list(chances), [0]
    for size in reversed(sizes):
        squares.append(squares[-1] + size * size)
    giants = 0
    while giants < len(sizes) and 4 * sizes[giants] ** 2 > squares[len(sizes) - giants - 1]:
        giants += 1
    # The smallest have few others below them too; at least half of all stay for the flight.
    giants = min(giants, len(sizes) // 2)
    for i in range(giants):
        if not 0.0 < p[i] < 1.0:
            continue
        rest = range(i + 1, len(sizes))

        def missed(x: float) -> float:
            words = (p[i] - x) * sizes[i]
            room = sum(sizes[j] * ((1 - p[j]) if words > 0 else p[j]) for j in rest)
            return max(abs(words) - room, 0.0)

        drawn = 1.0 if _draw(seed, ids[i], -1) < p[i] else 0.0
        if missed(drawn) > missed(1.0 - drawn):
            drawn = 1.0 - drawn
        words, p[i] = (p[i] - drawn) * sizes[i], drawn
        p[i + 1:] = _spread(sizes[i + 1:], p[i + 1:], words)
    return p, giants


def _bands(sizes: list[int], chances: list[float], reserve: int, begin: int) -> list[tuple[int, int]]:
    """Ranges of documents in falling size that fly one after the other: most, a band of their words, the smallest.

    The middle band starts where what it can give or take holds the largest document; no band takes over half.
    """
    end = len(sizes)
    half = (begin + end) // 2
    few = max(end - reserve, half)
    room, cut = 0.0, few
    while cut > half and room < sizes[begin]:
        cut -= 1
        room += sizes[cut] * min(chances[cut], 1 - chances[cut])
    return [(a, b) for a, b in ((begin, cut), (cut, few), (few, end)) if a < b]


def _flight(settings: MixSettings):
    def run(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["_size", "_id"], ascending=[False, True], kind="stable", na_position="last")
        ids, sizes, p = piece["_id"].tolist(), piece["_size"].tolist(), piece["_p"].tolist()
        last = piece["_pieces"].iloc[0] == 1
        p, giants = draw_giants(ids, sizes, p, settings.seed)
        # The smallest documents wait: they make good what the last fractions of the others miss.
        bands = _bands(sizes, p, settings.reserve, giants) if last else [
            (giants, max(giants, len(ids) - min(_HELD, len(ids) // 2)))]
        missing = 0.0
        for begin, end in bands:
            band = range(begin, end)
            goal = sum(sizes[i] * p[i] for i in band) + missing
            p[begin:end] = _spread(sizes[begin:end], p[begin:end], missing)
            open_at = [i for i in band if 0.0 < p[i] < 1.0]
            flown, left = fly([ids[i] for i in open_at], [sizes[i] for i in open_at], [p[i] for i in open_at],
                              settings.seed)
            for i, x in zip(open_at, flown):
                p[i] = x
            if last:
                left = [open_at[i] for i in left]
                rest = goal - sum(sizes[i] * p[i] for i in band if i not in left)
                for i, x in zip(left, land([sizes[i] for i in left], rest, sum(p[i] for i in left))):
                    p[i] = x
                missing = goal - sum(sizes[i] * p[i] for i in band)
        return piece.assign(_p=p).drop(columns="_piece")
    return run


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    ``size`` counts words (null text: 0); ``copies`` says how often the mix takes the row and ``taken`` is copies * size,
    at most ``cap`` times the size. A null source is a source of its own. Sources without words get no target and no
    copies. Repeated rows are units of their own. Reruns give the same sample: pieces, order and draws depend on
    ids alone. An empty table gives no rows.
    """
    source = F.col(source_col).cast("string")
    rows = stored(docs.select(
        F.col(id_col).alias("_id"), source.alias("_source"), word_count(F.col(text_col)).alias("_size"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_k")), "mix_rows")
    targets = source_targets(rows, settings).withColumn("_h", F.xxhash64("_k"))
    met = salted_lookup(rows.drop("_source").withColumn("_h", F.xxhash64("_k")), targets, ["_k"], "_h", ["_id"])
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(times + _TINY)
    chance = F.greatest(times - whole, F.lit(0.0))
    units = met.select("_id", "_k", "_size", "source_size", "target", whole.cast("bigint").alias("_whole"),
                       F.when(chance < _TINY, F.lit(0.0)).otherwise(chance).alias("_p"),
                       F.col("_docs").alias("_most"))
    schema = ("_id bigint, _k string, _size bigint, source_size bigint, target double, _whole bigint, _p double, "
              "_most bigint, _pieces bigint")
    units = units.withColumn("_id", F.col("_id").cast("bigint"))
    largest = targets.agg(F.max("_docs")).first()[0] or 0  # one number
    decided, level = [units.where("_p = 0").drop("_most")], units.where("_p > 0")
    while True:
        pieces = F.ceil(F.col("_most") / settings.piece)
        dealt = level.withColumn("_pieces", pieces).withColumn(
            "_piece", F.pmod(F.xxhash64("_id", F.lit(settings.seed)), F.col("_pieces")))
        flown = stored(dealt.groupBy("_k", "_piece").applyInPandas(_flight(settings), schema), "mix_flight")
        decided.append(flown.where("_p IN (0, 1)").drop("_most", "_pieces"))
        if largest <= settings.piece:
            break
        # Every piece leaves two fractions at most, and hands on a few documents.
        level = flown.where("_p > 0 AND _p < 1").withColumn("_most", (2 + _HELD) * F.col("_pieces")).drop("_pieces")
        largest = (2 + _HELD) * -(-largest // settings.piece)
    result = decided[0]
    for part in decided[1:]:
        result = result.unionByName(part)
    copies = (F.col("_whole") + F.col("_p").cast("bigint")).alias("copies")
    return result.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
                         (copies * F.col("_size")).alias("taken"), copies)


def mixed_rows(docs: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it. Rows are told apart by id, text and source."""
    key = free_name(docs, "_row_key")
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col, source_col))
    taken = mix(keyed, settings, key, text_col, source_col).groupBy(F.col("doc_id").alias("_taken_key")).agg(
        F.sum("copies").cast("int").alias("_times"))
    taken = stored(taken.where("_times > 0"), "mix_taken")
    times = free_name(docs, "_copy_number")
    unique = keyed.dropDuplicates([key])
    joined = unique.join(taken, unique[key] == taken["_taken_key"])
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col("_times")))).select(
        *[joined[f"`{c}`"] for c in docs.columns])
