"""Ranked demand lists of segments, summed from rollup rows and from lists that are stored already.

The combinations of a company's keys are few rows of that company, so its rows are dealt and sorted by the company's hash
once, and summed for all combinations in the same worker: nothing is expanded before the shuffle and no list is put together
entry by entry. Blocks of whole hashes are worked on as arrays, so a worker holds one block, or one company if that is larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from skillgrid.session import ship_package

# ``kept`` of a row that counts in each combination with its company fixed.
WITH_COMPANY = -1
COMPANY_MASKS = (2, 3, 6, 7)
KEYS = ("role_key", "company_key", "location_key")
DEMAND = "array<struct<demand_count:bigint,skill:string>>"
BLOCK = 60_000
# Segments sent back at once.
PIECE = 10_000


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of a key column, -1 for null, and its values, of which the last is the empty string of an open key."""
    listed = column.dictionary_encode()
    codes = pc.fill_null(listed.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(listed.dictionary, "").as_py()
    if blank >= 0:
        # One code for the empty string: the last one.
        codes[codes == blank] = len(listed.dictionary)
    return codes, pa.concat_arrays([listed.dictionary, pa.array([""], listed.dictionary.type)])


def _joined(codes: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """One number per row for several codes, ordered as they are."""
    key, size = codes[0]
    for code, n in codes[1:]:
        if size * n >= 2**62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * n + code, size * n
    return key


def _block_lists(block: pa.Table) -> pa.Table:
    """Segments of one block: entries are summed by segment and skill, those that come to zero go."""
    block = block.combine_chunks()
    column = {name: block[name].combine_chunks() for name in ("kept", *KEYS, "skill", "demand_count", "demand")}
    kept = column["kept"].to_numpy().astype(np.int64)
    coded = [_coded(column[k]) for k in KEYS]
    listed = column["demand_count"].is_null().to_numpy(zero_copy_only=False)
    stored, plain = np.flatnonzero(listed), np.flatnonzero(~listed)
    entries = column["demand"].flatten()

    # Skills by rank, so that numbers compare as names do; null is the first.
    names = pa.concat_arrays([entries.field("skill"), column["skill"].take(pa.array(plain))]).dictionary_encode()
    by_name = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(by_name) + 1, np.int64)
    rank[by_name], rank[-1] = np.arange(1, len(by_name) + 1), 0
    skills = rank[pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)]
    values = pa.concat_arrays([pa.nulls(1, names.dictionary.type), names.dictionary.take(pa.array(by_name))])
    counts = np.concatenate([entries.field("demand_count").to_numpy(zero_copy_only=False),
                             column["demand_count"].take(pa.array(plain)).to_numpy(zero_copy_only=False)]).astype(np.int64)

    # Each entry's row, its place in skills and counts, and its combination.
    lengths = pc.list_value_length(column["demand"]).take(pa.array(stored)).to_numpy(zero_copy_only=False)
    row, at = [np.repeat(stored, lengths)], [np.arange(len(entries))]
    mask = [kept[row[0]]]
    places = len(entries) + np.arange(len(plain))
    own = kept[plain] != WITH_COMPANY
    row, at, mask = row + [plain[own]], at + [places[own]], mask + [kept[plain[own]]]
    fine, fine_at = plain[~own], places[~own]
    for combination in COMPANY_MASKS:
        usable = np.ones(len(fine), bool)
        for (code, _), bit in zip(coded, (4, 2, 1)):
            if combination & bit:
                usable &= code[fine] >= 0
        row, at = row + [fine[usable]], at + [fine_at[usable]]
        mask.append(np.full(int(usable.sum()), combination, np.int64))
    row, at, mask = (np.concatenate(x) for x in (row, at, mask))
    keys = []
    for (code, shown), bit in zip(coded, (4, 2, 1)):
        keys.append((np.where(mask & bit, code[row], len(shown) - 1), len(shown)))

    n_names = len(values)
    key = _joined([(mask, 8), *keys, (skills[at], n_names)])
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[at][order], starts) if len(starts) else np.zeros(0, np.int64)
    held = sums != 0
    sums, key, first = sums[held], key[starts][held], order[starts][held]
    segment, skill = key // n_names, key % n_names
    heads = np.flatnonzero(np.diff(segment, prepend=segment[:1] - 1)) if len(segment) else np.zeros(0, np.int64)
    # Entries stand by skill, which a stable sort keeps among equal counts.
    ranked = np.lexsort((-sums, segment))
    demand = pa.StructArray.from_arrays(
        [pa.array(sums[ranked]), values.take(pa.array(skill[ranked]))], ["demand_count", "skill"])
    of = first[heads]
    shown = {name: values.take(pa.array(code[of])) for name, (code, _), (_, values) in zip(KEYS, keys, coded)}
    return pa.table({"kept": pa.array(mask[of], pa.int32()), **shown, "demand": pa.ListArray.from_arrays(
        pa.array(np.append(heads, len(sums)), pa.int32()), demand)})


def hash_blocks(batches, size: int, weigh):
    """Tables of about ``size`` by ``weigh`` from batches in the order of ``_deal``; no value of it is cut in two."""
    waiting, weight, limit = [], 0, size
    for batch in batches:
        waiting.append(batch)
        weight += weigh(batch)
        if weight >= limit:
            block = pa.Table.from_batches(waiting)
            deal = block["_deal"].to_numpy()
            whole = int(np.searchsorted(deal, deal[-1]))
            if whole:
                yield block.slice(0, whole)
                waiting = block.slice(whole).combine_chunks().to_batches()
                weight = sum(map(weigh, waiting))
            # A hash with more rows than a block goes on growing.
            limit = max(size, 2 * weight)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _lists(batches):
    for block in hash_blocks(batches, BLOCK, lambda batch: batch.num_rows + len(batch.column("demand").flatten())):
        yield from _block_lists(block).to_batches(max_chunksize=PIECE)


def summed_segments(rows: DataFrame) -> DataFrame:
    """One row per segment with its ranked demand.

    ``rows`` has kept, the three keys, and either skill and demand_count (which may be negative) or, where demand_count is
    null, demand, a list of a segment. Otherwise demand is empty, not null: the size of a batch is asked for each row, and
    Arrow walks back over all null lists before it. Rows with ``kept`` of WITH_COMPANY count in all combinations of their keys with the company; keys that are
    null are never fixed. Entries of zero and segments without entries drop out.
    """
    ship_package(rows.sparkSession)
    company = (F.col("kept") == WITH_COMPANY) | (F.col("kept").bitwiseAND(2) != 0)
    deal = F.when(company, F.xxhash64("company_key")).otherwise(F.xxhash64("kept", *KEYS))
    # The count is given, so adaptive execution does not merge small partitions: an entry costs more than its bytes suggest.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("kept", *KEYS, "skill", "demand_count", "demand", deal.alias("_deal"))
    return dealt.repartition(parts, "_deal").sortWithinPartitions("_deal").mapInArrow(
        _lists, f"kept int, role_key string, company_key string, location_key string, demand {DEMAND}")
