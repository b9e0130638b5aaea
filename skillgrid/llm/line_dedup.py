"""Repeated passages by content-defined line chunks, with DataFrame operations only.

A document is cut into chunks of lines. A chunk ends after a line if a rolling value over the hashes of the last
``window`` lines hits a residue, so the cuts depend on nearby lines alone: a passage that stands in many documents is
cut alike in all of them, whatever stands before it. A line as long as a passage is a chunk by itself. Chunks of several
lines, or of one such line, that occur more than once in the corpus are removed everywhere but at their first place,
after their bytes were compared.

Only chunk hashes and places are counted and joined; texts are moved once to find which hashed chunks really repeat
(grouped by the bytes themselves, pre-aggregated before the shuffle) and once to be rewritten.

Chunks miss repeats of one line between two cuts and the edges of most passages. ``remove_repeated_passages`` has no
cuts: every two lines in a row, and every line as long as a passage, is compared with all others, so a passage of two
lines or more goes as a whole, whatever stands around it, at the cost of moving each line twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.binding import bind
from skillgrid.llm.common import WORD, salted_lookup
from skillgrid.session import stored


def _line_value(line: Column) -> Column:
    """28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.md5(text).alias("_sha"), text.alias("_text"))


def line_chunks(texts: DataFrame, window: int, divisor: int, passage_words: int) -> DataFrame:
    """Add _lines and _chunks (structs n, long, chunk: lines, whether it is one long line, text) to texts."""
    hashed = texts.withColumn("_lines", F.split("_text", "\n", -1)).withColumns({
        "_values": F.transform("_lines", _line_value),
        "_long": F.transform("_lines", lambda line: F.regexp_count(line, F.lit(WORD)) >= passage_words)})

    def cut_after(value: Column, at: Column) -> Column:
        # The rolling value: the hash of the line ``step`` places back counts 31 ** step times.
        rolling = value
        for step in range(1, window):
            rolling = rolling + F.coalesce(F.get("_values", at - step), F.lit(0)) * (31 ** step)
        alone = F.get("_long", at) | F.coalesce(F.get("_long", at + 1), F.lit(False))
        return F.when((rolling % divisor == 0) | alone | (at == F.size("_values") - 1), at)

    ends = F.filter(F.transform("_values", cut_after), lambda e: e.isNotNull())

    def chunk(end: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("_ends", i - 1))
        return F.struct((end - before).alias("n"), F.get("_long", end).alias("long"),
                        F.array_join(F.slice("_lines", before + 2, end - before), "\n").alias("chunk"))

    return hashed.withColumn("_ends", ends).withColumn("_chunks", F.transform("_ends", chunk)).drop(
        "_values", "_ends", "_long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2,
                    divisor: int = 3, min_lines: int = 2, passage_words: int = 50) -> DataFrame:
    """Every later place of a repeated chunk: _id, _sha, _at, _chunk (the text to compare with)."""
    cut = line_chunks(_texts(docs, id_col, text_col), window, divisor, passage_words)
    placed = F.transform("_chunks", lambda c, i: F.struct(
        i.alias("at"), ((c["n"] >= min_lines) | c["long"]).alias("passage"), c["chunk"].alias("chunk")))
    several = F.filter(placed, lambda s: s["passage"] & (F.trim(s["chunk"]) != ""))
    rows = cut.select("_id", "_sha", F.explode(several).alias("_s")).select(
        "_id", "_sha", F.col("_s.at").alias("_at"), F.col("_s.chunk").alias("_chunk"),
        F.xxhash64("_s.chunk").alias("_h"))
    # Grouped by the bytes, so a shared hash alone makes no repeat.
    firsts = rows.groupBy("_h", "_chunk").agg(
        F.count("*").alias("_n"), F.min(F.struct("_id", "_sha", "_at")).alias("_first"))
    firsts = stored(firsts.where("_n > 1").drop("_n"), "repeated_chunks")
    places = rows.select("_id", "_sha", "_at", "_h")
    candidates = salted_lookup(places, firsts, [], "_h", ["_id", "_sha", "_at"])
    return candidates.where(F.struct("_id", "_sha", "_at") != F.col("_first")).select("_id", "_sha", "_at", "_chunk")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2,
                           divisor: int = 3, min_lines: int = 2, passage_words: int = 50) -> DataFrame:
    """One row per document: doc_id, text, n_lines, removed_lines, removed_chunks.

    The first place of a repeated chunk (smallest id, null ids first, then MD5 of the text, then position) keeps it;
    elsewhere its lines leave the text. A null or empty text is one empty line and stays empty. Chunks of blanks only
    are left alone. Rows that repeat id and text count as one place. Other columns of ``docs`` are not read.
    """
    found = repeated_chunks(docs, id_col, text_col, window, divisor, min_lines, passage_words)
    # At most one entry per chunk of the document itself.
    lists = found.groupBy("_id", "_sha").agg(F.collect_set(F.struct("_at", "_chunk")).alias("_drop"))
    left, right = _texts(docs, id_col, text_col).alias("a"), lists.alias("b")
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._sha") == F.col("b._sha"))
    joined = left.join(right, same, "left").select("a._id", "a._text", "b._drop")
    cut = line_chunks(joined, window, divisor, passage_words)
    # Byte comparison: a chunk goes only if it equals the stored text of the repeat.
    gone = F.transform("_chunks", lambda c, i: F.exists(
        F.coalesce("_drop", F.array().cast("array<struct<_at:int,_chunk:string>>")),
        lambda d: (d["_at"] == i) & (d["_chunk"] == c["chunk"])))
    kept = F.filter("_chunks", lambda c, i: ~F.get("_gone", i))
    lost = F.filter("_chunks", lambda c, i: F.get("_gone", i))
    return cut.withColumn("_gone", gone).select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(
            F.array_join(F.transform(kept, lambda c: c["chunk"]), "\n")).alias("text"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.aggregate(lost, F.lit(0).cast("bigint"), lambda s, c: s + c["n"]).alias("removed_lines"),
        F.size(lost).cast("bigint").alias("removed_chunks"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      passage_words: int = 50) -> DataFrame:
    """Every later place of a repeated line pair or long line: _id, _sha, _at, _n (lines), _chunk (their text)."""
    texts = _texts(docs, id_col, text_col).withColumn("_lines", F.split("_text", "\n", -1))

    def pair(line: Column, i: Column) -> Column:
        both = F.concat(line, F.lit("\n"), F.get("_lines", i + 1))  # null for the last line
        return F.struct(i.alias("at"), F.lit(2).alias("n"), both.alias("chunk"))

    def alone(line: Column, i: Column) -> Column:
        long = F.when(F.regexp_count(line, F.lit(WORD)) >= passage_words, line)
        return F.struct(i.alias("at"), F.lit(1).alias("n"), long.alias("chunk"))

    spans = F.concat(F.transform("_lines", pair), F.transform("_lines", alone))
    rows = texts.select("_id", "_sha", F.explode(F.filter(spans, lambda s: s["chunk"].rlike(WORD))).alias("_s")).select(
        "_id", "_sha", F.col("_s.at").alias("_at"), F.col("_s.n").alias("_n"), F.col("_s.chunk").alias("_chunk"),
        F.xxhash64("_s.chunk").alias("_h"))
    # Grouped by the bytes, so a shared hash alone makes no repeat.
    firsts = rows.groupBy("_h", "_n", "_chunk").agg(
        F.count("*").alias("_places"), F.min(F.struct("_id", "_sha", "_at")).alias("_first"))
    firsts = stored(firsts.where("_places > 1").drop("_places"), "repeated_passages")
    places = rows.select("_id", "_sha", "_at", "_n", "_h")
    found = salted_lookup(places, firsts, ["_n"], "_h", ["_id", "_sha", "_at"])
    # Three equal lines in a row hold one pair twice; the second place shares a line with the first and is none.
    same = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_sha") == F.col("_first._sha"))
    overlap = F.col("_at") - F.col("_first._at") < F.col("_n")
    return found.where(~(same & overlap)).select("_id", "_sha", "_at", "_n", "_chunk")


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             passage_words: int = 50) -> DataFrame:
    """One row per document: doc_id, text, n_lines, removed_lines, removed_passages (runs of removed lines).

    A line goes if it and a neighbour stand together at an earlier place too, or if it has ``passage_words`` and stands at
    an earlier place, so a repeated run of two lines or more, or of one long line, goes whole. Places are ordered as in
    ``remove_repeated_chunks``; the first place of every line stays. Two blank lines make no passage.
    """
    found = repeated_passages(docs, id_col, text_col, passage_words)
    # At most two entries per line of the document itself.
    lists = found.groupBy("_id", "_sha").agg(F.collect_set(F.struct("_at", "_n", "_chunk")).alias("_drop"))
    left, right = _texts(docs, id_col, text_col).alias("a"), lists.alias("b")
    on = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._sha") == F.col("b._sha"))
    joined = left.join(right, on, "left").select("a._id", "a._text", "b._drop")

    def rewritten(lines: Column) -> Column:
        # Byte comparison: lines go only if they equal the stored text of the repeat.
        equal = F.filter(F.coalesce("_drop", F.array().cast("array<struct<_at:int,_n:int,_chunk:string>>")), lambda d: (
            F.array_join(F.slice(lines, d["_at"] + 1, d["_n"]), "\n") == d["_chunk"]))
        gone = F.flatten(F.transform(equal, lambda d: F.sequence(d["_at"], d["_at"] + d["_n"] - 1)))

        def around(at: Column) -> Column:  # the kept lines between the removed ones
            def between(end: Column, i: Column) -> Column:
                before = F.when(i == 0, F.lit(-1)).otherwise(F.get(at, i - 1))
                return F.slice(lines, before + 2, end - before - 1)

            kept = F.flatten(F.transform(F.concat(at, F.array(F.size(lines))), between))
            runs = F.filter(at, lambda v, i: (i == 0) | (F.get(at, i - 1) != v - 1))
            return F.struct(F.array_join(kept, "\n").alias("text"), F.size(lines).alias("n"), F.size(at).alias("gone"),
                            F.size(runs).alias("runs"))

        return bind(F.sort_array(F.array_distinct(gone)), around)

    out = joined.withColumn("_out", bind(F.split("_text", "\n", -1), rewritten))
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_out.text").alias("text"), F.col("_out.n").cast("bigint").alias("n_lines"),
        F.col("_out.gone").cast("bigint").alias("removed_lines"),
        F.col("_out.runs").cast("bigint").alias("removed_passages"))
