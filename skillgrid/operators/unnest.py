"""Array entries as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unnest(df: DataFrame, keys: list[str], array: Column | str, item: str = "_item", position: str = "_at") -> DataFrame:
    """One row per entry of ``array``: keys, position from 0, entry. Empty and null arrays give no row.

    The outer form is used on purpose. For an inner explode the optimizer adds a filter on the array's size and
    pushes it to the scan together with everything the array is computed from, so that work would be done twice.
    """
    array = F.col(array) if isinstance(array, str) else array
    rows = df.select(*keys, F.posexplode_outer(array).alias(position, item))
    return rows.where(F.col(position).isNotNull())


def unnest_structs(df: DataFrame, keys: list[str], array: Column | str) -> DataFrame:
    """As ``unnest``, with the entry's fields as columns."""
    return unnest(df, keys, array).select(*keys, "_item.*")
