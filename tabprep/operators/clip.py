"""Limit values to bounds given as values or percentiles."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F

from ..plans.step import ColumnStep, default, register_step

METHODS = ("value", "percentile")


@register_step
class Clip(ColumnStep):
    """Values outside [u_min, u_max] move to the bound; NULL stays NULL."""

    action = "clip"
    numeric_only = True

    def __init__(self, column: str, method: str | None = "value", u_min: Any = "", u_max: Any = "") -> None:
        if method is None:
            raise ValueError("clip needs a method")
        super().__init__(column, method=method, u_min=u_min, u_max=u_max)
        self.method = default(method, "value").lower()
        if self.method not in METHODS:
            raise ValueError(f"unknown clip method: {method}")
        by_rank = self.method == "percentile"
        self.low = default(u_min, 0 if by_rank else None)
        self.high = default(u_max, 100 if by_rank else None)

    def aggregates(self, x: Column) -> dict[str, Column]:
        if self.method == "percentile" or (self.low is not None and self.high is not None):
            return {}
        return {"least": F.min(x), "most": F.max(x)}

    def quantiles(self) -> list[float]:
        return [self.low / 100, self.high / 100] if self.method == "percentile" else []

    def learn(self, found: dict[str, Any]) -> None:
        if self.method == "percentile":
            low, high = (found["quantiles"][p] for p in self.quantiles())
        else:
            low = found["least"] if self.low is None else self.low
            high = found["most"] if self.high is None else self.high
        self._bounds(low, high)

    def check(self, dtype) -> None:
        super().check(dtype)
        if self.method == "value" and self.low is not None and self.high is not None:
            self._bounds(self.low, self.high)

    def _bounds(self, low: Any, high: Any) -> None:
        if low is not None and high is not None and low > high:
            raise ValueError(f"lower clip bound above the upper one: {self.column}")
        self.state = {"low": low, "high": high}

    def expression(self, x: Column) -> Column:
        low, high = self.state["low"], self.state["high"]
        if low is None or high is None:
            return x
        return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))
