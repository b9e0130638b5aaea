"""Tagging with a table of terms of any size.

A term is filed under its core, from its first word to its last; what it has before and after (the dot of ".net", the
plus signs of "c++") are its edges. A text is cut once into words and the separators between them. Its runs of words, in
the lengths that cores have, are exploded and met with the term table by equality, so the cost follows the text and
the few lengths, not the number of terms, and Spark broadcasts the table only if its measured size allows. What leaves the
text is hits: term, place and whether each kind of boundary holds there.

Boundaries are flags of a hit. ``strict`` is a word boundary on both sides, so "c++" counts only before a word character.
``edge_aware`` asks that no word character touches the term, so "c++" counts in "c++, java" and not in "c++11".
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skillgrid.functions.binding import bind
from skillgrid.functions.hashing import is_any
from skillgrid.functions.text import WORD_CLASS, title_case, words
from skillgrid.operators.unnest import unnest_structs
from skillgrid.session import stored
from skillgrid.taxonomy import Taxonomy

_WORD = WORD_CLASS + "+"
_SLOT = 1 << 31  # places in a text: word i is slot 2i + 1, the separator before it slot 2i

# Measured bytes of terms up to which every task gets a copy, so that nothing of the texts is shuffled to meet them.
COPIED_BYTES = 128 << 20
_ROW_BYTES = 48  # of a copied term besides its text


@dataclass(frozen=True)
class TermIndex:
    """position, term, skill, core, lead, trail, repeats; and what the cutting of texts must know of all terms."""

    terms: DataFrame
    lengths: tuple[int, ...]  # words of a core
    edges: bool  # whether any term has a lead or a trail
    longest_sign: int  # characters of the longest term without a word
    listed: dict[int, list[str]] | None = None  # cores by number of words, where the terms are a list in the program
    size: int = 0  # bytes of the terms as a join holds them

    @property
    def bounded(self) -> bool:
        """Whether it matters what stands around a core."""
        return self.edges or self.longest_sign > 0

    @classmethod
    def from_terms(cls, spark: SparkSession, taxonomy: Taxonomy) -> TermIndex:
        """The terms of a list in its order."""
        listed = pa.table({"position": pa.array(range(len(taxonomy.terms)), pa.int32()),
                           "term": pa.array(taxonomy.terms, pa.string())})
        cores: dict[int, set[str]] = {}
        for term in taxonomy.terms:
            if found := re.findall(r"\w+", term):
                cores.setdefault(len(found), set()).add(re.sub(r"^\W+|\W+$", "", term))
        return replace(cls._of(spark.createDataFrame(listed)), listed={n: sorted(c) for n, c in cores.items()})

    @classmethod
    def from_table(cls, table: DataFrame, column: str = "term", order_by: str | None = None) -> TermIndex:
        """Distinct lower-cased terms of a table; null and empty ones drop out.

        ``order_by`` gives the order among equal counts (the smallest of a term's rows), else the terms' own does.
        """
        named = table.select(F.lower(column).alias("term"), F.col(order_by or column).alias("position")).where("term <> ''")
        # Written, so its size is known when a join is planned.
        return cls._of(stored(named.groupBy("term").agg(F.min("position").alias("position")), "terms"))

    @classmethod
    def from_text_file(cls, spark: SparkSession, path: str) -> TermIndex:
        """One term per line, blank lines skipped."""
        return cls.from_table(spark.read.text(path).select(F.trim("value").alias("term")))

    @classmethod
    def _of(cls, named: DataFrame) -> TermIndex:
        term, words_ = F.col("term"), F.col("_words")
        parts = F.split(term, _WORD, -1)
        border = F.exists(F.sequence(F.lit(2), F.length(term)), lambda at: F.startswith(term, F.substr(term, at)))
        cut = named.withColumns({"_words": F.regexp_count(term, F.lit(_WORD)), "_parts": parts})
        core = F.when(words_ == 0, term).otherwise(F.substr(
            term, F.length(F.get("_parts", F.lit(0))) + 1,
            F.length(term) - F.length(F.get("_parts", F.lit(0))) - F.length(F.element_at("_parts", -1))))
        edge = {"lead": F.get("_parts", F.lit(0)), "trail": F.element_at("_parts", -1)}
        cut_terms = cut.select(
            "position", "term", title_case(term).alias("skill"), core.alias("core"), "_words",
            *(F.when(words_ == 0, "").otherwise(e).alias(n) for n, e in edge.items()),
            ((F.length(term) > 1) & border).alias("repeats"))
        shape = cut_terms.agg(F.sort_array(F.collect_set(F.when(words_ > 0, words_))).alias("lengths"),
                          F.bool_or((F.col("lead") != "") | (F.col("trail") != "")).alias("edges"),
                          F.max(F.when(words_ == 0, F.length("term"))).alias("sign"),
                          F.sum(F.octet_length("term") + _ROW_BYTES).alias("size")).first()
        terms = cut_terms.drop("_words")
        return cls(terms, tuple(shape["lengths"]), bool(shape["edges"]), shape["sign"] or 0, size=shape["size"] or 0)


def _place(slot: Column, offset: Column) -> Column:
    return slot.cast("bigint") * _SLOT + offset


def _candidates(index: TermIndex, cut: Column, numbered: bool) -> Column:
    """What of a text may equal a core: structs (core, at, n), what stands around them if any term has edges, and the
    numbers of their words if ``numbered``.

    ``cut`` has the words ``w``, the separators ``s`` (one more) and may have ``of``, the number of the white-space
    separated word that each word stands in. ``at`` is the first word, ``n`` the number of words; a sign has none and
    stands ``cut`` characters into the separator ``before``.
    """
    w, s, count = cut["w"], cut["s"], F.size(cut["w"])
    nothing, bounded = F.lit(""), index.bounded

    def candidate(core: Column, at: Column, n: int, before: Column, after: Column, inside: Column) -> Column:
        fields = [core.alias("core"), at.alias("at"), F.lit(n).alias("n")]
        if bounded:
            fields += [before.alias("before"), after.alias("after"), inside.alias("cut"), (at == 0).alias("first"),
                       (at + n == count).alias("last")]
        if numbered:
            of = cut["of"]
            fields += [F.get(of, at).alias("here"), F.get(of, at + max(n - 1, 0)).alias("there"), cut["listed"].alias("words")]
            if bounded:
                # A strict hit with an edge depends on the word beyond that edge.
                fields += [F.get(of, at - 1).alias("left"), F.get(of, at + n).alias("right")]
        return F.struct(*fields)

    def run(length: int) -> Column:
        def core(i: Column) -> Column:
            parts = [F.get(w, i)]
            for step in range(1, length):
                parts += [F.get(s, i + step), F.get(w, i + step)]
            return F.concat(*parts) if length > 1 else parts[0]

        def known(i: Column) -> Column:
            """Cores of a list are known here, so other words need not leave the text."""
            cores = index.listed[length]
            if length == 1:
                return is_any(core(i), cores)
            opening = sorted({re.match(r"\w+", c)[0] for c in cores})
            return F.when(is_any(F.get(w, i), opening), is_any(core(i), cores)).otherwise(False)

        places = F.sequence(F.lit(0), count - length)
        if index.listed is not None:
            places = F.filter(places, known)
        return F.when(count >= length, F.transform(places, lambda i: candidate(
            core(i), i, length, F.get(s, i), F.get(s, i + length), F.lit(0))))

    def signs() -> Column:
        def within(separator: Column, i: Column) -> Column:
            size = F.length(separator)
            starts = F.when(size > 0, F.sequence(F.lit(0), size - 1))
            return F.flatten(F.transform(starts, lambda at: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(index.longest_sign), size - at)),
                lambda long: candidate(F.substr(separator, at + 1, long), i, 0, separator, nothing, at))))
        return F.flatten(F.array_compact(F.transform(s, within)))

    parts = [run(length) for length in index.lengths] + ([signs()] if index.longest_sign else [])
    return F.flatten(F.array_compact(F.array(*parts)))


def _cut_and_run(index: TermIndex, joined: Column, numbered: bool) -> Column:
    """``_candidates`` of a text, given as struct (t, n, of). What lambdas use is bound, or every entry would cut it again."""
    def cut_and_run(j: Column) -> Column:
        cut = F.struct(F.regexp_extract_all(j["t"], F.lit(_WORD), F.lit(0)).alias("w"),
                       F.split(j["t"], _WORD, -1).alias("s"), j["of"].alias("of"), j["n"].alias("listed"))
        return bind(cut, lambda c: _candidates(index, c, numbered))
    return bind(joined, cut_and_run)


def _whole(text: str) -> Column:
    """A text that is not cut into chunks, for ``_cut_and_run``."""
    return F.struct(F.lower(F.col(text)).alias("t"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))


def term_hits(df: DataFrame, keys: list[str], text: str, index: TermIndex, collapse: int | None = None) -> DataFrame:
    """keys, position, term, skill, repeats, start, stop, strict, edge_aware of every place of a term.

    With ``collapse`` the words of a text are first joined by single blanks, and three columns follow: the white-space
    separated words that a strict hit depends on (``first_word``, ``last_word``; null in texts of at most ``collapse``
    words) and how many ``words`` the text has. A null text has no hits.
    """
    if not index.lengths and not index.longest_sign:
        empty = df.select(*keys, F.lit(0).alias("_w")).where("false").crossJoin(index.terms.limit(0))
        return empty.select(*keys, "position", "term", "skill", "repeats", *(F.lit(0).cast("bigint").alias(c) for c in (
            "start", "stop")), F.lit(False).alias("strict"), F.lit(False).alias("edge_aware"), *(
            F.lit(0).alias(c) for c in (("first_word", "last_word", "words") if collapse is not None else ())))
    if collapse is not None:
        listed = words(F.lower(F.col(text)))
        # One entry per word run: the white-space separated word it stands in.
        joined = bind(listed, lambda ws: F.struct(
            F.array_join(ws, " ").alias("t"), F.size(ws).alias("n"),
            F.when(F.size(ws) > collapse, F.flatten(F.transform(
                ws, lambda w, i: F.array_repeat(i, F.regexp_count(w, F.lit(_WORD)))))).alias("of")))
    else:
        joined = _whole(text)

    # Only the entries leave the text: a row does not carry what the others are made of.
    found = _cut_and_run(index, joined, collapse is not None)
    met = unnest_structs(df.select(*keys, found.alias("_found")), keys, "_found").join(index.terms, "core")
    if not index.bounded:
        unseen = {"before": F.lit(""), "after": F.lit(""), "cut": F.lit(0), "first": F.lit(False), "last": F.lit(False)}
        met = met.withColumns(unseen | ({"left": F.lit(0), "right": F.lit(0)} if collapse is not None else {}))
    lead, trail, before, after = (F.col(c) for c in ("lead", "trail", "before", "after"))
    size, sign = F.length("core"), F.col("n") == 0
    left_cut, right_cut = F.col("cut") > 0, F.col("cut") + size < F.length(before)
    strict = F.when(sign, ~F.col("first") & ~F.col("last") & ~left_cut & ~right_cut).otherwise(
        ((lead == "") | ((before == lead) & ~F.col("first"))) & ((trail == "") | ((after == trail) & ~F.col("last"))))
    aware = F.when(sign, (F.col("first") | left_cut) & (F.col("last") | right_cut)).otherwise(
        ((lead == "") | (F.endswith(before, lead) & (F.col("first") | (F.length(before) > F.length(lead)))))
        & ((trail == "") | (F.startswith(after, trail) & (F.col("last") | (F.length(after) > F.length(trail))))))
    start = F.when(sign, _place(F.col("at") * 2, F.col("cut"))).when(
        lead == "", _place(F.col("at") * 2 + 1, F.lit(0))).otherwise(
        _place(F.col("at") * 2, F.length(before) - F.length(lead)))
    stop = F.when(sign, _place(F.col("at") * 2, F.col("cut") + size)).when(
        trail == "", _place((F.col("at") + F.col("n")) * 2, F.lit(0))).otherwise(
        _place((F.col("at") + F.col("n")) * 2, F.length(trail)))
    spans = []
    if collapse is not None:
        spans = [F.when(sign | (lead != ""), F.col("left")).otherwise(F.col("here")).alias("first_word"),
                 F.when(sign | (trail != ""), F.col("right")).otherwise(F.col("there")).alias("last_word"),
                 F.col("words")]
    return met.select(*keys, "position", "term", "skill", "repeats", start.alias("start"), stop.alias("stop"),
                      strict.alias("strict"), aware.alias("edge_aware"), *spans)


def count_mentions(hits: DataFrame, by: list[str], edge_aware: bool = False) -> DataFrame:
    """by, position, term, skill, mentions: places that do not overlap, taken from the left."""
    kept = hits.where("edge_aware" if edge_aware else "strict")
    place = F.struct("start", "stop")
    # Only a term that can overlap itself needs its places.
    grouped = kept.groupBy(*by, "position", "term", "skill", "repeats").agg(
        F.count("*").alias("_n"), F.sort_array(F.collect_list(F.when(F.col("repeats"), place))).alias("_places"))
    apart = F.aggregate("_places", F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
                        lambda done, p: F.when(p["start"] >= done["end"], F.struct(
                            p["stop"].alias("end"), (done["n"] + 1).alias("n"))).otherwise(done), lambda done: done["n"])
    return grouped.select(*by, "position", "term", "skill", F.when(F.col("repeats"), apart).otherwise(F.col("_n")).alias("mentions"))


def _by_core(entries: Column) -> Column:
    """A text's entries as one struct per core: core, n, count, and its first words ``at`` where places could overlap."""
    def grouped(listed: Column) -> Column:
        size = F.size(listed)
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1))
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(listed, i)["core"] != F.get(listed, i - 1)["core"]))

        def entry(first: Column, count: Column) -> Column:
            return bind(F.get(listed, first), lambda e: F.struct(
                e["core"].alias("core"), e["n"].alias("n"), count.alias("count"),
                F.when((e["n"] > 1) & (count > 1), F.transform(F.slice(listed, first + 1, count), lambda x: x["at"])).alias("at")))

        return bind(firsts, lambda starts: F.transform(starts, lambda first, i: bind(
            F.coalesce(F.get(starts, i + 1), size) - first, lambda count: entry(first, count))))

    return bind(F.sort_array(entries), grouped)


def _mentions_in_rows(df: DataFrame, keys: list[str], text: str, index: TermIndex) -> DataFrame:
    """``mentions_by_term`` where no term has edges and no two rows have the same keys: a text is counted in its row.

    A text meets a term once, with its count, and what it meets is an answer: nothing is grouped afterwards.
    """
    found = unnest_structs(df.select(*keys, _by_core(_cut_and_run(index, _whole(text), False)).alias("_found")), keys, "_found")
    terms = index.terms.select("core", "position", "term", "skill", "repeats")
    met = found.join(F.broadcast(terms) if index.size <= COPIED_BYTES else terms, "core")
    apart = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda done, at: F.when(
        at >= done["end"], F.struct((at + F.col("n")).alias("end"), (done["n"] + 1).alias("n"))).otherwise(done),
        lambda done: done["n"])
    mentions = F.when(F.col("repeats") & F.col("at").isNotNull(), apart).otherwise(F.col("count"))
    return met.select(*keys, "position", "term", "skill", mentions.cast("bigint").alias("mentions"))


def mentions_by_term(df: DataFrame, keys: list[str], text: str, index: TermIndex, edge_aware: bool = False) -> DataFrame:
    """keys, position, term, skill, mentions; ``keys`` tell texts apart. Rows with the same keys are counted as one text.

    Where no term has edges, both kinds of boundary always hold and only rows whose keys come again are shuffled.
    """
    if index.bounded or not index.lengths:
        return count_mentions(term_hits(df, keys, text, index), keys, edge_aware)
    again = stored(df.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1").select(
        *(F.col(k).alias(f"_again_{k}") for k in keys)), "repeated_keys")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_again_{k}"))
    once = _mentions_in_rows(df.join(again, same, "left_anti"), keys, text, index)
    return once.unionByName(count_mentions(term_hits(df.join(again, same, "left_semi"), keys, text, index), keys, edge_aware))


def chunk_maxima(df: DataFrame, keys: list[str], text: str, index: TermIndex, size: int, overlap: int) -> DataFrame:
    """keys, skill, score: the largest count of strict hits over the text's overlapping chunks of words.

    The text is cut once; a hit belongs to the chunks whose words it needs, found by arithmetic on its word numbers.
    """
    hits, step = term_hits(df, keys, text, index, collapse=size).where("strict"), size - overlap
    last_chunk = F.greatest(F.lit(0), F.ceil((F.col("words") - size) / step))
    low = F.greatest(F.lit(0), F.ceil((F.coalesce("last_word", F.lit(0)) + 1 - size) / step)).cast("int")
    high = F.least(F.floor(F.coalesce("first_word", F.lit(0)) / step), last_chunk).cast("int")
    placed = hits.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn(
        "_chunk", F.explode(F.sequence("_low", "_high")))
    counted = count_mentions(placed, [*keys, "_chunk"])
    return counted.groupBy(*keys, "skill").agg(F.max("mentions").alias("score"))
