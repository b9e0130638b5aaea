"""Look-ups in a mapping that is a literal of the plan, without walking it."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, functions as F


def _buckets(items: dict[str, object]) -> list[list]:
    buckets: list[list] = [[] for _ in range(max(1, len(items)))]
    for key, item in items.items():
        buckets[zlib.crc32(key.encode()) % len(buckets)].append(item)
    return buckets


def _bucket(buckets: list[list], entry: str, key: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{entry}>>")
    return F.get(table, (F.crc32(key) % len(buckets)).cast("int"))


def is_any(key: Column, values: list[str]) -> Column:
    """``key.isin(values)``; a long list is one constant of the plan instead of one for each value."""
    if len(values) <= 100:
        return key.isin(values)
    return F.array_contains(_bucket(_buckets({v: v for v in values}), "string", key), key)


def hashed_lookup(values: dict[str, object], key: Column, kind: str) -> Column:
    """Value of ``key``, null where it is absent. Entries lie in buckets by CRC-32, about one in each.

    The buckets are one constant, which the optimizer works out once.
    """
    buckets = _buckets({k: {"k": k, "v": v} for k, v in values.items()})
    bucket = _bucket(buckets, f"struct<k:string,v:{kind}>", key)
    return F.get(F.filter(bucket, lambda e: e["k"] == key), F.lit(0))["v"]
