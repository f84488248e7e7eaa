"""Column steps: what a step must learn, and the expressions it turns into.

A step never touches data itself. It names the aggregates, quantiles or levels it needs over the
current expression of its column; the pipeline computes these for all columns of a wave together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, types as T

STEPS: dict[str, type["ColumnStep"]] = {}


def register_step(cls: type["ColumnStep"]) -> type["ColumnStep"]:
    """Class decorator: makes a step usable in requests and in saved models."""
    STEPS[cls.action] = cls
    return cls


class ColumnStep:
    """One action on one column. Subclass and register to add your own."""

    action: ClassVar[str] = ""
    numeric_only: ClassVar[bool] = False

    def __init__(self, column: str, **params: Any) -> None:
        self.column = column
        self.params = params
        self.state: dict[str, Any] = {}

    def check(self, dtype: T.DataType) -> None:
        """Raise when the parameters do not suit the column's type."""
        if self.numeric_only and not isinstance(dtype, T.NumericType):
            raise TypeError(f"{self.action} needs a numeric column: {self.column}")

    def aggregates(self, x: Column) -> dict[str, Column]:
        """Named aggregates to learn from."""
        return {}

    def quantiles(self) -> list[float]:
        """Exact quantiles to learn from, as shares of 1."""
        return []

    def level_limit(self) -> int | None:
        """Most levels the step can hold; None when it needs no levels."""
        return None

    def stateful(self, x: Column) -> bool:
        return bool(self.aggregates(x) or self.quantiles() or self.level_limit() is not None)

    def learn(self, found: dict[str, Any]) -> Callable[[Column], dict[str, Column]] | None:
        """Fill `state` from aggregates, `quantiles` {p: value}, `levels` [(value, n)] and `mode`.

        A step that searches may return a function from the column to further aggregates; they are
        computed in one more pass and `learn` is called again.
        """
        return None

    def learn_many(self, df: DataFrame, x: Column) -> None:
        """Called before `learn` when the column x of df has more levels than the step's limit."""

    def expression(self, x: Column) -> Column:
        raise NotImplementedError

    def outputs(self, x: Column) -> list[tuple[str, Column]]:
        """Result columns; most steps keep the name."""
        return [(self.column, self.expression(x))]

    def joined(self, df: DataFrame, key: Sequence[str] = ()) -> DataFrame | None:
        """A step that needs the whole table (a join, a position) returns the new frame here."""
        return None

    def to_dict(self) -> dict[str, Any]:
        return {"action": self.action, "column": self.column, "params": self.params, "state": self.state}

    @staticmethod
    def from_dict(saved: dict[str, Any]) -> "ColumnStep":
        step = STEPS[saved["action"]](saved["column"], **saved["params"])
        step.state = saved["state"]
        return step


def default(value: Any, fallback: Any) -> Any:
    """Absent, "" and "null" all mean the documented default."""
    return fallback if value is None or value in ("", "null") else value
