"""Registered queries of the corpus operators: production parameters over the whole intended table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skillgrid.llm import (alignment, conversations, exact_dedup, jaccard_join, language, license_scan, line_dedup, mixing,
                           packing, piece_encoding, sharding, token_files, vector_search)
from skillgrid.llm.common import ship_package, table
from skillgrid.session import scratch_path

END_ID = 2
PACKED_END_ID = 1
WORD_BITS = 16  # ids of the word tokenizer are below 49,408

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Parts of operators that SQL can state where the whole has none.
PART_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, on the driver and the executors alike."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    (LLM_QUERIES if fn.__name__.startswith("op") else PART_QUERIES)[fn.__name__] = run
    return run


@query
def op1_exact_dedup(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


@query
def op2_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def mixing_targets(spark, sf):
    """The part of op2 that SQL can state: sizes and targets."""
    return mixing.mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"))


@query
def op3_license_scan(spark, sf):
    return license_scan.scan_licenses(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def license_words(spark, sf):
    """The part of op3 that SQL can state: words and the places of the base phrases."""
    return license_scan.scan_licenses(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@query
def op4_language_id(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query
def op5_sharding(spark, sf):
    tree = sharding.ShardTree.regular(regions=2, racks=3, shards=4)
    return sharding.shard_documents(table(spark, sf, "documents"), tree)


@query
def op6_token_files(spark, sf):
    path = scratch_path(spark, "token_files")
    token_files.write_token_files(table(spark, sf, "documents"), path, tokenizer_file("word_bpe_49k.json"), END_ID,
                                  WORD_BITS)
    return token_files.decoded_documents(token_files.read_token_files(spark, path))


@query
def op7_vector_search(spark, sf):
    return vector_search.nearest_vectors(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op8_jaccard_join(spark, sf):
    settings = jaccard_join.JaccardSettings(words=4, similar=85, whole=100)
    return jaccard_join.jaccard_components(table(spark, sf, "documents"), settings)


@query
def op9_line_dedup(spark, sf):
    return line_dedup.remove_repeated_chunks(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "removed_lines", "removed_chunks", F.md5("text").alias("text_md5"),
        F.char_length("text").cast("bigint").alias("kept_chars"))


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Ids of every document and whether they decode to its text, as digests."""
    model = piece_encoding.PieceModel.from_file(tokenizer_file("piece_bpe_32k.model"))
    own = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    back = piece_encoding.round_trip_documents(own, model, keep=("text_md5",))
    listed = F.array_join("ids", ",")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.crc32(listed).alias("ids_crc32"),
                       (F.md5("text") == F.col("text_md5")).alias("round_trip"))


@query
def op10_piece_encoding(spark, sf):
    return encoded_digests(table(spark, sf, "documents"))


@query
def op11_token_alignment(spark, sf):
    return alignment.align_documents(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"),
                                     tokenizer_file("piece_bpe_32k.model"))


@query
def op12_conversation_repair(spark, sf):
    return conversations.repair_conversations(conversations.damage(table(spark, sf, "conversations")))


@query
def op13_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), PACKED_END_ID,
                                  window=2048)


def repeated_passages(spark, sf):
    """op9 without cuts: every repeated passage of two lines or of one long line."""
    ship_package(spark)
    return line_dedup.remove_repeated_passages(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "removed_lines", "removed_passages", F.md5("text").alias("text_md5"),
        F.char_length("text").cast("bigint").alias("kept_chars"))
