"""Exact copies by deterministic block naming, with DataFrame operations only.

A normalised text is cut into fixed-size blocks. The distinct blocks are sorted and numbered, so a document becomes a
list of integers. Adjacent integers are then named as pairs, again by sorting the distinct pairs, until one integer is
left. At each level equal names mean equal content (names are given to the content itself, not to a hash of it), so two
documents with as many blocks are equal exactly if their last names are. Hashes only route rows.

The first level moves every text twice (to number the distinct blocks, and to hand the numbers back); each later level
moves a few integers per document and halves them. A block or pair that very many documents share meets its number in
many tasks (salted look-up), and copies are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skillgrid.llm.common import ascii_lower, free_name, salted_lookup, without_rows
from skillgrid.session import stored

_ODD = -1  # stands for the missing right half of an odd last name; names are never negative


def _renamed(occurrences: DataFrame, keys: list[str], share: int = 1_000) -> DataFrame:
    """Replace the keys of every occurrence (_id, _sha, _at) by their name and gather each document's names.

    The distinct keys are counted, sorted inside their hash partition and numbered: partition and place make up the (even)
    name. A key with over one in ``share`` of all occurrences is hot; there are at most ``share`` of them, so their names
    are broadcast, as odd numbers of their own. All other occurrences meet their names where these were made. Hot and other
    names both read the counts, so one shuffle of the keys serves all.
    """
    names = occurrences.groupBy("_h", *keys).agg(F.count("*").alias("_rows")).sortWithinPartitions(
        "_h", *keys).withColumn("_name", F.monotonically_increasing_id() * 2)
    piece = F.greatest(F.ceil(names.agg(F.sum("_rows")).scalar() / share), F.lit(200))
    hot_names = F.broadcast(names.where(F.col("_rows") > piece).select("_h", *keys, (F.col("_name") + 1).alias("_hot")))
    names = names.where(F.col("_rows") <= piece).drop("_rows")
    known = occurrences.join(hot_names, ["_h", *keys], "left")
    done = F.col("_hot").isNotNull()
    # Named rows only pass through the join: dealt evenly and without their text.
    passing = {k: F.when(~done, F.col(k)) for k in keys}
    passing["_h"] = F.when(done, F.xxhash64("_id", "_sha", "_at")).otherwise(F.col("_h"))
    found = known.withColumns(passing).join(names, ["_h", *keys], "left").withColumn(
        "_name", F.coalesce("_hot", "_name"))
    # A document's own names: as many as its blocks. Repeated rows bring the same (place, name) again.
    listed = found.groupBy("_id", "_sha").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("_at", "_name"))), lambda s: s["_name"]).alias("_names"),
        F.max("_blocks").alias("_blocks"), F.sum(F.when(F.col("_at") == 0, F.col("_copies"))).alias("_copies"))
    return stored(listed, "block_names")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_chars: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, and all empty texts are equal. The row
    with the largest id stays. Rows with the same id and text are copies of each other: one of them stays. Null ids
    come after all others, so such a row stays only in a group without any id. An empty table gives no rows. Other
    columns of ``docs`` are not read. ``block_chars`` counts UTF-8 bytes, so a letter may lie in two blocks.
    """
    base = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
    # Cut as bytes: a place in them is found at once, one in characters only by counting from the start.
    size, raw = int(block_chars), F.col("_norm").cast("binary")
    last = F.greatest(F.ceil(F.octet_length("_norm") / size).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))
    blocks = base.select("_id", F.sha2("_norm", 256).alias("_sha"), cut.alias("_cut"))
    occurrences = blocks.select("_id", "_sha", F.size("_cut").alias("_blocks"), F.lit(1).cast("bigint").alias("_copies"),
                                F.posexplode_outer("_cut").alias("_at", "_block")).withColumn("_h", F.xxhash64("_block"))
    level = _renamed(occurrences, ["_block"])
    finished = []
    while True:
        finished.append(level.where(F.size("_names") == 1))
        level = level.where(F.size("_names") > 1)
        if level.isEmpty():
            break
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("_names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("_names", i * 2).alias("_left"),
                               F.coalesce(F.get("_names", i * 2 + 1), F.lit(_ODD)).alias("_right")))
        paired = level.select("_id", "_sha", "_blocks", "_copies", F.posexplode_outer(pairs).alias("_at", "_pair")).select(
            "_id", "_sha", "_blocks", "_copies", "_at", "_pair._left", "_pair._right")
        level = _renamed(paired.withColumn("_h", F.xxhash64("_left", "_right")), ["_left", "_right"])
    named = finished[0]
    for part in finished[1:]:
        named = named.unionByName(part)
    # Equal texts have as many blocks and so finish at the same level: (number of blocks, name) is the identity.
    named = named.select("_id", "_sha", "_copies", "_blocks", F.get("_names", F.lit(0)).alias("_name"),
                         F.xxhash64("_blocks", F.get("_names", F.lit(0))).alias("_h"))
    groups = named.groupBy("_h", "_blocks", "_name").agg(
        F.max("_id").alias("keep_id"), F.sum("_copies").alias("group_size"))
    joined = salted_lookup(named, groups, ["_blocks", "_name"], "_h", ["_id", "_sha"])
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id; repeated rows once."""
    found = stored(exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(
        F.bool_or("kept").alias("_stays"), F.count("*").alias("_rows")), "exact_groups")
    sha = free_name(docs, "_text_sha")
    marked = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    return without_rows(marked, found.select("doc_id", F.xxhash64("text_sha256").alias("_h"), "_stays", "_rows"),
                        id_col, F.xxhash64(sha)).drop(sha)
