"""Helpers the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, data_type
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so two engines' last bits do not matter; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(col(c), digits) + F.lit(0.0)).alias(c) if isinstance(data_type(df, c), T.DoubleType) else col(c)
            for c in df.columns
        ]
    )


class Book:
    """Collects (query, SQL) pairs under one name."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query defined twice: {name}")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
