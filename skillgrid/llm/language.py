"""Language identification by rank-order profiles of character n-grams.

Training counts the n-grams (one to three characters of lower-cased words, with word ends) of every training text per
language; each language keeps its most frequent ones in rank order. A text is ranked the same way and gets the language
with the smallest out-of-place distance: the sum, over the text's n-grams, of how far each stands from its rank in the
profile, with a fixed penalty where the profile lacks it.

Counting runs in Arrow batches; a task merges its counts before they are shuffled, so what is shuffled are distinct
n-grams per task and language. Profiles have languages x profile_size rows, and languages are refused beyond a bound, so
they may be broadcast. Prediction is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from skillgrid.session import stored

PROFILE_SIZE = 300
MAX_LANGUAGES = 500
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SHIFT = 21  # bits of a code point
_SPACE = 32
_MERGE_AT = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def text_grams(text: str) -> np.ndarray:
    """All 1- to 3-grams of a text as integers; everything between letters is one word end."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[codes]
    codes = np.where(letter, codes, _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    if not len(codes):
        return codes
    if codes[0] != _SPACE:
        codes = np.concatenate(([_SPACE], codes))
    if codes[-1] != _SPACE:
        codes = np.concatenate((codes, [_SPACE]))
    pairs = (codes[:-1] << _SHIFT) | codes[1:]
    triples = ((codes[:-2] << (2 * _SHIFT)) | pairs[1:])[codes[1:-1] != _SPACE]
    return np.concatenate((codes[codes != _SPACE], pairs, triples))


def ranked(grams: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, smaller integers first among equals."""
    distinct, counts = np.unique(grams, return_counts=True)
    return distinct[np.lexsort((distinct, -counts))[:size]]


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        grams, counts = _merged(*held.pop(lang))
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": counts})

    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            grams, counts = np.unique(text_grams(text), return_counts=True)
            lists = held.setdefault(lang, ([], []))
            lists[0].append(grams)
            lists[1].append(counts)
            if len(lists[0]) == 256:
                merged = _merged(*lists)
                held[lang] = ([merged[0]], [merged[1]])
                if len(merged[0]) > _MERGE_AT:
                    yield flush(lang)
        if len(held) > MAX_LANGUAGES:
            for lang in list(held):
                yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def train_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   profile_size: int = PROFILE_SIZE) -> DataFrame:
    """Profiles (lang, gram, rank) from all labelled texts; rows without text or language teach nothing."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_count_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    # Cut in pieces first: the last ranking of a language sees pieces * profile_size rows however many n-grams it has.
    order = [F.col("n").desc(), F.col("gram")]
    piece = F.row_number().over(Window.partitionBy("lang", F.pmod("gram", F.lit(64))).orderBy(*order))
    top = counts.withColumn("_r", piece).where(F.col("_r") <= profile_size)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return top.withColumn("rank", rank).where(F.col("rank") <= profile_size).select("lang", "gram", "rank")


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


class ProfileSet:
    """Profiles as sorted n-grams with one column of ranks per language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, dtype=np.int64)
        for at, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.int64)), at] = np.arange(
                len(profiles[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and a score from 0 (nothing in common) to 1 (the very profile)."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        own = ranked(text_grams(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        place = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        theirs = self.ranks[place]
        missing = (theirs < 0) | (self.grams[place] != own)[:, None]
        apart = np.where(missing, self.size, np.abs(theirs - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))  # ties: the first language by code point
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: DataFrame, carry: list[str], text_col: str = "text",
            profile_size: int = PROFILE_SIZE) -> DataFrame:
    """The columns in ``carry`` of every row as struct ``row``, with lang_pred, score and has_letter.

    ``und`` with score 0 where the text is null or has no letter. Ties go to the first language by code point. With no
    learned language every row is ``und``. Rows are independent and pass through, so nothing is joined back.
    """
    # At most MAX_LANGUAGES * profile_size rows; more languages are refused, not cut.
    listed = profiles.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("p")).limit(
        MAX_LANGUAGES + 1).collect()
    if len(listed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the training rows")
    shared = docs.sparkSession.sparkContext.broadcast(
        ProfileSet({r["lang"]: [e["gram"] for e in r["p"]] for r in listed}, profile_size))
    apart = text_col not in carry  # else the text is read from the carried row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch["text"] if apart else batch["row"].field(text_col)
            texts = texts.to_pylist()
            found = [known.nearest(text) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([has_letter(text) for text in texts], pa.bool_())],
                names=["row", "lang_pred", "score", "has_letter"])

    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in carry]).alias("row"),
                       *([docs[text_col].alias("text")] if apart else []))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("has_letter", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """One third of all documents, by the checksum of the id as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def learned_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Profiles of the documents that are not held out, written once."""
    return stored(train_profiles(docs.where(~held_out(id_col)), text_col, lang_col), "language_profiles")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score.

    Repeated rows get equal answers; other columns of ``docs`` are not read.
    """
    found = predict(docs, learned_profiles(docs, id_col, text_col, lang_col), [id_col], text_col)
    out = found.select(F.col("row").getField(id_col).alias("doc_id"), "lang_pred", "score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that can have no language: those without text or letters, whatever was learned."""
    found = predict(docs, learned_profiles(docs, id_col, text_col, lang_col), docs.columns, text_col)
    return found.where("has_letter").select("row.*")
