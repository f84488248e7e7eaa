"""Fill gaps."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..plans.step import ColumnStep, default, register_step

STRATEGIES = ("mean", "median", "most_frequent", "constant")
NUMERIC_FILL = 10
TEXT_FILL = "DEFAULT"
ABSENT_NUMERIC_FILL = 0
ABSENT_TEXT_FILL = "missing_value"


@register_step
class Impute(ColumnStep):
    """NULL becomes the column's mean, median, most frequent value or a constant."""

    action = "impute"

    def __init__(self, column: str, imp_strategy: str | None = "", fill_value: Any = None) -> None:
        if imp_strategy is None:
            raise ValueError("impute needs a strategy")
        super().__init__(column, imp_strategy=imp_strategy, fill_value=fill_value)
        self.strategy = default(imp_strategy, "most_frequent").lower()
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown impute strategy: {imp_strategy}")

    def check(self, dtype: T.DataType) -> None:
        numeric = isinstance(dtype, T.NumericType)
        fill = self.params["fill_value"]
        if not numeric and self.strategy in ("mean", "median"):
            raise TypeError(f"{self.strategy} needs a numeric column: {self.column}")
        if self.strategy == "constant":
            if fill is None:
                fill = ABSENT_NUMERIC_FILL if numeric else ABSENT_TEXT_FILL
            elif fill == "":
                fill = NUMERIC_FILL if numeric else TEXT_FILL
            if numeric and isinstance(fill, str) or not numeric and not isinstance(fill, str):
                raise TypeError(f"fill value does not suit column {self.column}")
            self.state["fill"] = fill
        self.state["numeric"] = numeric

    def aggregates(self, x: Column) -> dict[str, Column]:
        return {"mean": F.avg(x)} if self.strategy == "mean" else {}

    def quantiles(self) -> list[float]:
        return [0.5] if self.strategy == "median" else []

    def level_limit(self) -> int | None:
        return 0 if self.strategy == "most_frequent" else None

    def learn(self, found: dict[str, Any]) -> None:
        if self.strategy == "mean":
            self.state["fill"] = found["mean"]
        elif self.strategy == "median":
            self.state["fill"] = found["quantiles"][0.5]
        elif self.strategy == "most_frequent":
            self.state["fill"] = found["mode"]

    def expression(self, x: Column) -> Column:
        fill = self.state["fill"]
        return x if fill is None else F.coalesce(x, F.lit(fill))
