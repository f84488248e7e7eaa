"""Numeric column to bin numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, require_numeric
from ..plans.step import ColumnStep, default, register_step
from .rank import global_rank

METHODS = ("kbins", "equal length", "equal frequency")
DEFAULT_BINS = 5
EDGE_ABS = 1e-8
EDGE_REL = 1e-5


def uniform_bin(x: Column, least: float, width: float, bins: int) -> Column:
    """Bin number 0 … bins-1 between evenly spaced edges; a value on an edge goes up."""
    d = x.cast("double")
    lifted = d + (F.lit(EDGE_ABS) + F.lit(EDGE_REL) * F.abs(d))
    if width == 0:
        return F.when(d.isNotNull(), F.lit(0))
    slot = F.floor((lifted - F.lit(least)) / F.lit(width))
    return F.when(d.isNotNull(), F.greatest(F.least(slot, F.lit(bins - 1)), F.lit(0)).cast("int"))


def equal_frequency(df: DataFrame, column: str, value: int, key: Sequence[str]) -> DataFrame:
    """Replace `column` by floor(position / value): every bin but the last holds `value` rows; NULL stays."""
    require_numeric(df, [column])
    if value < 1:
        raise ValueError("rows per bin must be at least 1")
    ranked = global_rank(df, [col(column).asc_nulls_last()], key, "__rank")
    label = F.when(col(column).isNotNull(), F.floor(F.col("__rank") / F.lit(value)))
    return ranked.withColumn(column, label).drop("__rank").select(*[col(c) for c in df.columns])


@register_step
class Bin(ColumnStep):
    """Uniform bins by number (kbins) or width (equal length), or equally filled bins by position.

    Equal frequency keeps no state: it labels the table at hand, as positions mean nothing elsewhere.
    """

    action = "bin_variables"
    numeric_only = True

    def __init__(self, column: str, bin_method: str | None = "kbins", bin_value: Any = None) -> None:
        if bin_method is None:
            raise ValueError("bin_variables needs a method")
        super().__init__(column, bin_method=bin_method, bin_value=bin_value)
        self.method = default(bin_method, "kbins").lower()
        self.value = default(bin_value, DEFAULT_BINS)
        if self.method not in METHODS:
            raise ValueError(f"unknown bin method: {bin_method}")
        if isinstance(self.value, (str, bool)) or self.value <= 0:
            raise TypeError("bin value must be a positive number")

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {} if self.method == "equal frequency" else {"least": F.min(x), "most": F.max(x)}

    def learn(self, found: dict[str, Any]) -> None:
        least, most = found["least"], found["most"]
        if least is None:
            self.state = {"least": 0.0, "width": 0.0, "bins": 1}
            return
        span = float(most) - float(least)
        bins = math.ceil(self.value) if self.method == "kbins" else math.ceil(span / self.value)
        if span > 0 and bins < 2:
            raise ValueError(f"fewer than two bins: {self.column}")
        self.state = {"least": float(least), "width": span / bins if bins else 0.0, "bins": bins}

    def expression(self, x: Column) -> Column:
        return uniform_bin(x, self.state["least"], self.state["width"], self.state["bins"])

    def joined(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame | None:
        if self.method != "equal frequency":
            return None
        rest = [c for c in df.columns if c != self.column]
        return equal_frequency(df, self.column, int(self.value), list(key) or rest)
