"""Similarity tagging: texts that come with a vector against the vectors of the taxonomy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.functions.skills import canonical_name, score_points
from skillgrid.operators.unnest import unnest

TOP_K_MAX = 120
# The matrix of the taxonomy is sent to every task, so its rows are bounded; larger input is refused, never cut.
MAX_VECTORS = 10_000
DEFAULT_THRESHOLD = 0.18
# Text-term scores held in a task at one time, whatever the batch and taxonomy sizes.
SCORES_AT_ONCE = 2_000_000


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def taxonomy_matrix(vectors: DataFrame) -> tuple[list[str], np.ndarray]:
    """Canonical names and unit vectors of a taxonomy table (name, vector).

    Refused, not cut, above the size limit, and refused if vectors differ in length or lack a number.
    """
    rows = vectors.select(canonical_name(F.col("name")).alias("name"), "vector", F.col("name").alias("listed")).orderBy(
        "listed").limit(MAX_VECTORS + 1).collect()
    if len(rows) > MAX_VECTORS:
        raise ValueError(f"taxonomy table has more than {MAX_VECTORS} rows")
    if len({len(r["vector"] or ()) for r in rows}) > 1 or any(x is None for r in rows for x in r["vector"] or (None,)):
        raise ValueError("taxonomy vectors must have one length and no missing numbers")
    return [r["name"] for r in rows], _unit(np.array([r["vector"] for r in rows], dtype="float64"))


def _comparable(vector: Column, width: int) -> Column:
    return F.coalesce((F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def rejected_vectors(texts: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """Keys of the texts whose vector cannot be compared: of another length than the taxonomy's, or with a null in it."""
    width = taxonomy_matrix(vectors)[1].shape[-1]
    return texts.where(F.col("vector").isNotNull() & ~_comparable(F.col("vector"), width)).select(key)


def similarity_hits(texts: DataFrame, key: str, vectors: DataFrame, top_k: int = 50,
                    threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Per text its most similar skills: the best ``top_k``, of which those reaching the threshold (key, name, score).

    Listed names that become one canonical name count once, with the best score. Texts whose vector has another length
    or a null are left to ``rejected_vectors``. Rows stay in their partition: each Arrow batch is one matrix product with
    the taxonomy, and only hits leave it.
    """
    names, matrix = taxonomy_matrix(vectors)
    k = max(1, min(int(top_k), len(names), TOP_K_MAX))
    labels, sense = np.unique(np.array(names, dtype=object), return_inverse=True)
    step = max(1, SCORES_AT_ONCE // max(1, len(names)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            column = batch.column(1)
            data = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
            sims = _unit(data.reshape(batch.num_rows, -1)) @ matrix.T
            # Stable order: best score first, name order (the matrix order) among equals.
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            chosen = np.take_along_axis(sims, best, axis=1)
            row, place = np.nonzero(chosen >= threshold)
            meant = sense[best[row, place]]
            # Best score first, so the first place of a name is its best.
            first = np.sort(np.unique(row * len(labels) + meant, return_index=True)[1])
            row, place, meant = row[first], place[first], meant[first]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(labels[meant], pa.string()),
                 pa.array(chosen[row, place], pa.float64())], names=[key, "name", "raw_score"])

    key_type = texts.schema[key].dataType.simpleString()
    given = texts.select(key, "vector").where(_comparable(F.col("vector"), matrix.shape[-1]))
    hits = given.mapInArrow(score, f"{key} {key_type}, name string, raw_score double")
    return hits.select(key, "name", F.bround("raw_score", 4).alias("score"))


def hybrid_hits(similar: DataFrame, mentioned: DataFrame, key: str, top_k: int = 50,
                threshold: float = DEFAULT_THRESHOLD, taxonomy_size: int = TOP_K_MAX) -> DataFrame:
    """Add text hits (key, skill) at least at the threshold, rank again and cut again at ``top_k``.

    Ranks per text are over at most one row per taxonomy term.
    """
    k = max(1, min(int(top_k), taxonomy_size, TOP_K_MAX))
    text_hits = mentioned.select(key, canonical_name(F.col("skill")).alias("name"), F.lit(float(threshold)).alias("score"))
    merged = similar.select(key, "name", "score").unionByName(text_hits).groupBy(key, "name").agg(
        F.bround(F.max("score"), 4).alias("score"))
    ranked = merged.groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "name"))).alias("all"))
    return unnest(ranked, [key], F.slice("all", 1, k)).select(
        key, (F.col("_at") + 1).alias("rank"), "_item.name", (-F.col("_item.minus")).alias("score"))


def ensemble_tags(similar: DataFrame, mentioned: DataFrame, key: str, vectored: DataFrame,
                  threshold: float = DEFAULT_THRESHOLD, use_text: bool = True) -> DataFrame:
    """Similarity scores as points merged with mention counts under one name, the larger value kept.

    ``vectored`` lists the keys that came with a vector. Those texts are tagged by similarity (and text, if
    ``use_text``), and by text alone if nothing was similar; a text without a vector falls back to its text.
    ``extraction_mode`` and ``used_fallback`` say per text what was done.
    """
    points = similar.where(F.col("score") >= threshold).select(
        key, canonical_name(F.col("name")).alias("skill"), score_points(F.col("score")).cast("bigint").alias("points"))
    points = points.groupBy(key, "skill").agg(F.max("points").alias("points"))
    counts = mentioned.select(key, canonical_name(F.col("skill")).alias("skill"), "mentions").groupBy(
        key, "skill").agg(F.max("mentions").alias("mentions"))
    if not use_text:
        counts = counts.join(points.select(key).distinct(), key, "left_anti")
    both = points.join(counts, [key, "skill"], "full_outer")
    merged = both.select(key, "skill", F.greatest(F.coalesce("points", F.lit(0)), F.coalesce("mentions", F.lit(0)))
                         .alias("value"))
    labelled = merged.join(vectored.select(key).distinct().withColumn("_vector", F.lit(True)), key, "left")
    mode = F.when(F.col("_vector"), F.lit("ml_hybrid" if use_text else "ml")).otherwise(F.lit("regex"))
    return labelled.select(key, "skill", "value", mode.alias("extraction_mode"),
                           F.col("_vector").isNull().alias("used_fallback"))
