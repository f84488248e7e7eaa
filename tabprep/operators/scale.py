"""Bring a column to a common scale."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F

from ..plans.step import ColumnStep, default, register_step

METHODS = {
    "standardscaler": "standard",
    "minmaxscaler": "minmax",
    "maxabsscaler": "maxabs",
    "robustscaler": "robust",
}


@register_step
class Scale(ColumnStep):
    """(x - center) / spread; a spread of zero counts as one."""

    action = "scale"
    numeric_only = True

    def __init__(self, column: str, scale_method: str | None = "standardscaler") -> None:
        if scale_method is None:
            raise ValueError("scale needs a method")
        super().__init__(column, scale_method=scale_method)
        name = default(scale_method, "standardscaler").lower().replace(" ", "")
        if name not in METHODS:
            raise ValueError(f"unknown scale method: {scale_method}")
        self.method = METHODS[name]

    def aggregates(self, x: Column) -> dict[str, Column]:
        if self.method == "standard":
            return {"mean": F.avg(x), "std": F.stddev_pop(x)}
        if self.method == "minmax":
            return {"least": F.min(x), "most": F.max(x)}
        if self.method == "maxabs":
            return {"size": F.max(F.abs(x))}
        return {}

    def quantiles(self) -> list[float]:
        return [0.25, 0.5, 0.75] if self.method == "robust" else []

    def learn(self, found: dict[str, Any]) -> None:
        if self.method == "standard":
            center, spread = found["mean"], found["std"]
        elif self.method == "minmax":
            center, spread = found["least"], None if found["least"] is None else found["most"] - found["least"]
        elif self.method == "maxabs":
            center, spread = 0, found["size"]
        else:
            low, center, high = (found["quantiles"][p] for p in (0.25, 0.5, 0.75))
            spread = None if low is None else high - low
        self.state = {"center": None if center is None else float(center), "spread": float(spread or 1.0)}

    def expression(self, x: Column) -> Column:
        if self.state["center"] is None:
            return x.cast("double")
        return (x.cast("double") - F.lit(self.state["center"])) / F.lit(self.state["spread"])

    def inverse(self, z: Column) -> Column:
        """Back to the column's own unit."""
        return z * F.lit(self.state["spread"]) + F.lit(self.state["center"])
