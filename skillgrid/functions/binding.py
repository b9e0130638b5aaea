"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once per row.

    A column that is used inside a lambda is worked out again for every array entry, also when it comes from an
    earlier projection that the optimizer merges into this one. A lambda's own argument is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
