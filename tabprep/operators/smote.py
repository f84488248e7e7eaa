"""Synthetic minority rows between neighbours of one class (Chawla et al. 2002)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.choose import mapped
from ..functions.columns import col, require_numeric
from ..functions.hashing import hash32, uniform
from ..session import pinned
from .balance import drawn_rows, held_counts, wanted_rows
from .neighbors import knn_join


def _class_spread(df: DataFrame, target: str, features: Sequence[str]) -> dict[str, float]:
    """Per class the median of the population standard deviations of its numeric columns."""
    rows = df.groupBy(col(target).cast("string").alias("c")).agg(*[F.stddev_pop(col(f)) for f in features]).collect()
    return {r[0]: float(np.median([v or 0.0 for v in r[1:]])) for r in rows}


def _refuse_gaps(rows: DataFrame, features: Sequence[str], numeric: Sequence[str], key: str) -> None:
    """A missing value has no neighbours and a key that repeats would multiply draws: both are errors, not fewer rows."""
    gaps = [F.count_if(col(c).isNull() | (F.isnan(col(c).cast("double")) if c in numeric else F.lit(False))).alias(f"g{i}") for i, c in enumerate(features)]
    found = rows.agg(*gaps).first()
    missing = [c for i, c in enumerate(features) if found[i]]
    if missing:
        raise ValueError(f"missing values in {', '.join(missing)}: impute first")
    if not rows.groupBy(col(key)).count().where((F.col("count") > 1) | col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is not a key of the rows to sample from")


def _synthesize(
    df: DataFrame, target: str, categorical: Sequence[str], strategy, k: int, key: str, seed: int, method: str, layered: int | None
) -> DataFrame:
    numeric = [c for c in df.columns if c not in (target, key, *categorical)]
    require_numeric(df, numeric)
    counts = held_counts(df, target)
    wanted = wanted_rows(counts, method, strategy)
    need = {c: wanted[c] - counts[c] for c in counts if wanted[c] > counts[c]}
    if not need:
        return df
    if any(counts[c] < 2 for c in need):
        raise ValueError("a class of one row has no neighbours")
    rows = df.where(col(target).isin(*need))
    _refuse_gaps(rows, [*numeric, *categorical], numeric, key)
    base = pinned(drawn_rows(rows, target, need, counts, [key], seed))
    mismatch = _class_spread(rows, target, numeric) if categorical else None
    near = knn_join(
        rows.join(base.select(key).distinct(), key, "left_semi"), rows, numeric, k, key, target, categorical, mismatch, layered=layered
    )
    # a class smaller than k has fewer neighbours to choose from
    choices = mapped(col(target), {c: min(k, counts[c] - 1) for c in need})
    chosen = (
        base.withColumn("place", F.pmod(hash32(f"{seed}n", col(target), F.col("j")), choices).cast("int"))
        .withColumn("__u", uniform(f"{seed}u", col(target), F.col("j")))
        .join(near.select(key, "place", "neighbour_x"), [key, "place"])
    )
    made = chosen
    new = {
        c: (col(c).cast("double") + F.col("__u") * (F.col("neighbour_x")[i] - col(c).cast("double")))
        for i, c in enumerate(numeric)
    }
    if categorical:
        # k rows per base row: the most frequent category, the smallest on a tie
        modes = near.groupBy(key).agg(
            *[F.mode(F.col("neighbour_s")[i], True).alias(f"__m{i}") for i in range(len(categorical))]
        )
        made = made.join(modes, key)
        new |= {c: F.col(f"__m{i}") for i, c in enumerate(categorical)}
    synthetic = made.select(
        *[
            new[c].alias(c) if c in new else F.lit(None).cast(df.schema[c].dataType).alias(c) if c == key else col(c)
            for c in df.columns
        ]
    )
    originals = df.withColumns({c: col(c).cast("double") for c in numeric})
    return originals.unionByName(synthetic)


def smote(
    df: DataFrame, target: str, strategy: str | float | dict = "auto", k_neighbors: int = 5, key: str = "id", seed: int = 5, layered: int | None = None
) -> DataFrame:
    """Add rows x + u·(neighbour - x) of each class up to the wanted number; their key is NULL.

    Which row, which of its k nearest neighbours and u depend only on seed, class and draw number. Neighbours are exact, or with
    `layered` those found in that many cells of a layered index (see `knn_join`): for many dimensions and many rows.
    """
    return _synthesize(df, target, (), strategy, k_neighbors, key, seed, "SMOTE", layered)


def smote_nc(
    df: DataFrame,
    target: str,
    categorical_features: Sequence[str],
    strategy: str | float | dict = "auto",
    k_neighbors: int = 5,
    key: str = "id",
    seed: int = 5,
    layered: int | None = None,
) -> DataFrame:
    """As `smote` with categories: they add to the distance and take the neighbours' most frequent value."""
    if not categorical_features:
        raise ValueError("Categorical SMOTE needs a categorical column")
    return _synthesize(df, target, tuple(categorical_features), strategy, k_neighbors, key, seed, "Categorical SMOTE", layered)
