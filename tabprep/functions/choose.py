"""Look-ups in short sorted lists as a balanced tree of comparisons, so a thousand entries cost ten tests a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, functions as F


def _tree(x: Column, bounds: Sequence[Any], leaf: Callable[[int], Column], low: int, high: int) -> Column:
    """Leaf i for bounds[i-1] <= x < bounds[i], over leaves low … high."""
    if low == high:
        return leaf(low)
    middle = (low + high) // 2
    left, right = _tree(x, bounds, leaf, low, middle), _tree(x, bounds, leaf, middle + 1, high)
    return F.when(x < F.lit(bounds[middle]), left).otherwise(right)


def step_value(x: Column, bounds: Sequence[Any], values: Sequence[Any]) -> Column:
    """values[i] for bounds[i-1] <= x < bounds[i]; one more value than bounds."""
    return _tree(x, bounds, lambda i: F.lit(values[i]), 0, len(values) - 1)


def mapped(x: Column, table: dict[Any, Any]) -> Column:
    """table[x], NULL for other values and for NULL."""
    if not table:
        return F.lit(None)
    keys = sorted(table)
    found = _tree(x, keys[1:], lambda i: F.when(x == F.lit(keys[i]), F.lit(table[keys[i]])), 0, len(keys) - 1)
    return F.when(x.isNotNull(), found)
