"""Row filters and checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, require


def remove_null(df: DataFrame, column: str) -> DataFrame:
    """Drop whole rows with a gap in `column`."""
    require(df, [column])
    return df.where(col(column).isNotNull())


def remove_duplicates(
    df: DataFrame, key: Sequence[str] = (), target: str | None = None, features: Sequence[str] | None = None
) -> DataFrame:
    """One row per distinct feature tuple: the one with the smallest key, its target kept.

    Features are all columns but the key and the target. The minimum is taken map-side, so a tuple that
    fills a third of the table reaches the shuffle as one row per task.
    """
    require(df, key)
    if features is None:
        features = [c for c in df.columns if c != target and c not in key]
    rest = [c for c in df.columns if c not in features]
    if not rest:
        return df.dropDuplicates(list(features))
    first_by = [c for c in key if c in rest] + [c for c in rest if c not in key]
    kept = F.min(F.struct(*[col(c) for c in first_by])).alias("__kept")
    grouped = df.groupBy(*[col(c) for c in features]).agg(kept)
    return grouped.select(*[col(c) if c in features else F.col("__kept").getField(c).alias(c) for c in df.columns])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) of every column in one job."""
    names = list(columns or df.columns)
    require(df, names)
    counted = df.agg(*[F.count_if(col(n).isNull()).alias(f"n{i}") for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("nulls")) for i, n in enumerate(names)])
    return counted.select(F.inline(pairs))


def check_null(df: DataFrame, column: str, action: str) -> int:
    """Number of gaps; an error when there are some and the action cannot stand them."""
    require(df, [column])
    nulls = df.agg(F.count_if(col(column).isNull())).first()[0]
    if nulls and action.lower().replace(" ", "") not in ("impute", "removenull"):
        raise ValueError(f"{nulls} null values in {column}: {action} needs a column without gaps")
    return nulls


def sanitize_names(df: DataFrame) -> DataFrame:
    """Keep only letters, digits and underscores in column names; two equal results are an error."""
    names = [re.sub(r"[^A-Za-z0-9_]+", "", c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns would get the same name")
    return df.toDF(*names)


def union_append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name, absent ones NULL."""
    return a.unionByName(b, allowMissingColumns=True)
