"""Skill tagging: whole-word matches of a fixed taxonomy in free text.

A term matches where the text has it between word boundaries. Cutting a text into alternating runs of word and
other characters turns that into equality: a term matches exactly where its own runs appear as consecutive runs of
the text. So one pass over the text and hashed look-ups replace one regular-expression scan per term, and the whole step
is a projection: no join, no shuffle, no Python. The terms of a list are literals of the plan; a table of terms of any
size is a ``TermIndex``, which the functions with ``keys`` take as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.binding import bind
from skillgrid.functions.hashing import hashed_lookup, is_any
from skillgrid.functions.text import WORD_CLASS, chunk_count, title_case, word_chunks, word_runs, words
from skillgrid.operators.term_index import TermIndex, chunk_maxima, mentions_by_term
from skillgrid.operators.unnest import unnest, unnest_structs
from skillgrid.taxonomy import Taxonomy


def _is_word_edge(char: str) -> bool:
    return char.isalnum() or char == "_"


def _sequence_hits(runs: Column, length: int, terms: list[str]) -> Column:
    """Terms of one run count found in the text, once per occurrence."""
    if length == 1:
        # A lone run of other characters can only match with a word on both sides.
        inner = [t for t in terms if not _is_word_edge(t[0])]
        plain = [t for t in terms if _is_word_edge(t[0])]
        found = F.filter(runs, lambda r: is_any(r, plain))
        if inner:
            last = F.size(runs) - 1
            found = F.concat(found, F.filter(runs, lambda r, i: is_any(r, inner) & (i > 0) & (i < last)))
        return found

    firsts = sorted({Taxonomy.runs(t)[0] for t in terms})
    # A term that starts (ends) with a non-word character needs a word before (after) it.
    open_left = [t for t in terms if not _is_word_edge(t[0])]
    open_right = [t for t in terms if not _is_word_edge(t[-1])]

    def candidate(run: Column, at: Column) -> Column:
        joined = F.concat(run, *[F.get(runs, at + step) for step in range(1, length)])
        ok = is_any(joined, terms)
        if open_left:
            ok = ok & ((at > 0) | ~is_any(joined, open_left))
        if open_right:
            ok = ok & ((at + length < F.size(runs)) | ~is_any(joined, open_right))
        return F.when(is_any(run, firsts), F.when(ok, joined))

    return F.filter(F.transform(runs, candidate), lambda t: t.isNotNull())


def _overlapping_hits(text: Column, term: str) -> Column:
    quoted = rf"(?<!{WORD_CLASS})" if _is_word_edge(term[0]) else rf"(?<={WORD_CLASS})"
    quoted += rf"\Q{term}\E"
    quoted += rf"(?!{WORD_CLASS})" if _is_word_edge(term[-1]) else rf"(?={WORD_CLASS})"
    return F.regexp_extract_all(text, F.lit(quoted), F.lit(0))


def _terms_found(text: str, taxonomy: Taxonomy) -> Column:
    """Terms found in ``text``, once per occurrence. The text is lower-cased and cut once, not for every run in it."""
    nothing = F.array().cast("array<string>")

    def hits(cut: Column) -> Column:
        parts = [_sequence_hits(cut["runs"], n, terms) for n, terms in sorted(taxonomy.by_length.items())]
        parts += [_overlapping_hits(cut["lowered"], t) for t in taxonomy.self_overlapping]
        return F.coalesce(F.concat(*parts), nothing) if parts else nothing

    return bind(F.lower(F.col(text)), lambda lowered: bind(
        F.struct(lowered.alias("lowered"), word_runs(lowered).alias("runs")), hits))


def with_skill_hits(df: DataFrame, text: str, taxonomy: Taxonomy, out: str = "hits") -> DataFrame:
    """Add ``out``: one struct (position, term, skill, mentions) per term of the taxonomy found in ``text``."""
    found = _terms_found(text, taxonomy)

    def counted(listed: Column) -> Column:
        """Equal terms stand together; a term's count is the distance to the next one's first place."""
        n = F.size(listed)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(listed, i) != F.get(listed, i - 1)))
        return bind(firsts, lambda starts: F.transform(starts, lambda at, i: bind(F.get(listed, at), lambda t: F.struct(
            hashed_lookup(taxonomy.position, t, "int").alias("position"),
            t.alias("term"),
            title_case(t).alias("skill"),
            (F.coalesce(F.get(starts, i + 1), n) - at).cast("bigint").alias("mentions")))))

    return df.withColumn(out, F.sort_array(bind(F.sort_array(found), counted)))


def with_skills(df: DataFrame, text: str, taxonomy: Taxonomy, out: str = "skills") -> DataFrame:
    """Add ``out``: the distinct names of the skills found in ``text``, sorted; nothing is counted for them."""
    named = F.transform(F.array_distinct(_terms_found(text, taxonomy)), title_case)
    return df.withColumn(out, F.sort_array(F.array_distinct(named)))


def skill_mentions(df: DataFrame, keys: list[str], text: str, taxonomy: Taxonomy | TermIndex) -> DataFrame:
    """One row per text and skill found in it."""
    if isinstance(taxonomy, TermIndex):
        return mentions_by_term(df, keys, text, taxonomy).select(*keys, "skill", "mentions")
    tagged = with_skill_hits(df.select(*keys, text), text, taxonomy)
    return unnest_structs(tagged, keys, "hits").select(*keys, "skill", "mentions")


def skill_list(hits: Column) -> Column:
    """Distinct skill names, sorted."""
    return F.sort_array(F.array_distinct(F.transform(hits, lambda h: h["skill"])))


def top_hits(hits: Column, top_n: int | None = 25) -> Column:
    """Most-mentioned skills first, taxonomy order among equals; ``None`` keeps all."""
    ranked = F.sort_array(F.transform(hits, lambda h: F.struct(
        (-h["mentions"]).alias("minus"), h["position"].alias("position"),
        h["skill"].alias("skill"), h["mentions"].alias("mentions"))))
    if top_n is not None:
        ranked = F.slice(ranked, 1, max(1, int(top_n)))
    return F.transform(ranked, lambda h, i: F.struct(
        (i + 1).alias("rank"), h["skill"].alias("skill"), h["mentions"].alias("mentions")))


def top_skills(df: DataFrame, keys: list[str], text: str, taxonomy: Taxonomy | TermIndex,
               top_n: int | None = 25) -> DataFrame:
    if isinstance(taxonomy, TermIndex):
        # At most one entry per distinct word run of the text in each group.
        hits = mentions_by_term(df, keys, text, taxonomy).groupBy(*keys).agg(F.collect_list(F.struct(
            "position", "term", "skill", "mentions")).alias("hits"))
        return unnest_structs(hits, keys, top_hits(F.col("hits"), top_n))
    tagged = with_skill_hits(df.select(*keys, text), text, taxonomy)
    return unnest_structs(tagged, keys, top_hits(F.col("hits"), top_n))


def required_skills(df: DataFrame, keys: list[str], text: str, required: list[str]) -> DataFrame:
    """One row per text and required skill, with a flag for its presence."""
    tagged = with_skill_hits(df.select(*keys, text), text, Taxonomy.from_terms(required))
    present = F.transform("hits", lambda h: h["term"])
    checks = F.array(*[F.struct(F.lit(r).alias("skill"), F.array_contains(present, r.lower()).alias("found"))
                       for r in dict.fromkeys(required)])
    return unnest_structs(tagged, keys, checks)


def tag_postings(postings: DataFrame, taxonomy: Taxonomy | TermIndex) -> DataFrame:
    """Fill ``skills`` from title and description: distinct names, sorted. With a table of terms, by ``job_uid``."""
    text = F.concat_ws(" ", F.col("title"), F.col("description"))
    if isinstance(taxonomy, TermIndex):
        named = mentions_by_term(postings.select("job_uid", text.alias("_text")), ["job_uid"], "_text", taxonomy)
        listed = named.groupBy("job_uid").agg(F.sort_array(F.collect_set("skill")).alias("_skills"))
        return postings.join(listed, "job_uid", "left").withColumn(
            "skills", F.coalesce("_skills", F.array().cast("array<string>"))).drop("_skills")
    return with_skills(postings.withColumn("_text", text), "_text", taxonomy).drop("_text")


def chunk_texts(df: DataFrame, keys: list[str], text: str, size: int = 700, overlap: int = 90) -> DataFrame:
    """One row per overlapping word window of each text; texts without a word give no row."""
    split = df.select(*keys, words(F.col(text)).alias("_words"))
    return unnest(split, keys, word_chunks(F.col("_words"), size, overlap), "chunk_text", "chunk")


def resume_skills(df: DataFrame, keys: list[str], text: str, taxonomy: Taxonomy | TermIndex,
                  size: int = 700, overlap: int = 90) -> DataFrame:
    """Per text and skill the largest count over the text's chunks; the words are tagged once, not per chunk."""
    index = taxonomy if isinstance(taxonomy, TermIndex) else TermIndex.from_terms(df.sparkSession, taxonomy)
    return chunk_maxima(df, keys, text, index, size, overlap)


def extraction_summary(chunk_meta: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the metadata of a text's chunks (mode, model version, fallback flag, taxonomy size, skills found).

    ``skills`` lists what each chunk found, at most one entry per term; a text's total counts a skill once.
    """
    def joined(column: str, separator: str) -> Column:
        return F.concat_ws(separator, F.sort_array(F.collect_set(column)))

    return chunk_meta.groupBy(*keys).agg(
        joined("extraction_mode", "+").alias("extraction_mode"),
        F.nullif(joined("model_version", ","), F.lit("")).alias("model_version"),
        F.bool_or("used_fallback").alias("used_fallback"),
        F.max("taxonomy_size").alias("taxonomy_size"),
        F.size(F.array_distinct(F.flatten(F.collect_set("skills")))).alias("skills_detected_total"),
        F.count("*").alias("chunks_processed"),
    )


def resume_report(df: DataFrame, keys: list[str], text: str, taxonomy: Taxonomy | TermIndex, preview: int = 500,
                  size: int = 700, overlap: int = 90) -> DataFrame:
    """One row per resume: length, skills with their scores, preview and extraction metadata.

    Only hits and the preview are shuffled, never the texts.
    """
    body = F.col(text)
    n_terms = taxonomy.terms.count() if isinstance(taxonomy, TermIndex) else len(taxonomy.terms)
    base = df.select(
        *keys,
        F.length(body).alias("text_length"),
        F.substring(body, 1, preview).alias("preview"),
        chunk_count(words(body), size, overlap).alias("chunks_processed"),
    )
    scored = resume_skills(df, keys, text, taxonomy, size, overlap)
    # At most one entry per taxonomy term in each group.
    found = scored.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("skill", "score"))).alias("skill_details"))
    has_words = F.col("chunks_processed") > 0
    details = F.coalesce("skill_details", F.array().cast("array<struct<skill:string,score:bigint>>"))
    return base.join(found, keys, "left").select(
        *keys,
        "text_length",
        F.size(details).alias("skills_found"),
        F.transform(details, lambda d: d["skill"]).alias("skills"),
        details.alias("skill_details"),
        "preview",
        F.when(has_words, F.lit("regex")).otherwise(F.lit("empty")).alias("extraction_mode"),
        F.lit(False).alias("used_fallback"),
        F.when(has_words, F.lit(n_terms)).otherwise(F.lit(0)).alias("taxonomy_size"),
        "chunks_processed",
    )
