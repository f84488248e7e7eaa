"""Kernel machines as linear fits on random Fourier features (Rahimi and Recht 2007).

The kernel exp(-gamma |x - y|²) of standardised rows is the expected product of cosines of random projections. The projections
come from hashes, so every run and every task has the same ones; work and memory are rows times features, never rows squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import classification as mc, regression as mr
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, require_numeric
from ..plans.pipeline import run_aggregates
from ..session import shuffle_width
from .models import PREDICTION, decoded
from .trees import draw

SIZE = 256  # cosines
PART_BYTES = 64 << 20  # cosines of one partition of training rows


@lru_cache(maxsize=8)
def projection(seed: int, p: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(size x p standard normal weights, size shifts in [0, 2 pi)): Box-Muller of the md5 of seed|cosine|column."""
    weights, shifts = np.empty((size, p)), np.empty(size)
    for j in range(size):
        for i in range(p):
            u, v, _, _ = draw(seed, j, i)
            weights[j, i] = math.sqrt(-2 * math.log(u or 2.0**-33)) * math.cos(2 * math.pi * v)
        shifts[j] = 2 * math.pi * draw(seed, j, "shift")[0]
    return weights, shifts


@dataclass
class FourierMap:
    """Columns to `size` cosines; a gap counts as the column's mean."""

    features: list[str]
    means: list[float]
    scales: list[float]
    gamma: float
    size: int = SIZE
    seed: int = 5

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], gamma: float | None = None, size: int = SIZE, seed: int = 5) -> "FourierMap":
        """Means and deviations from one pass; gamma is 1 / columns by default. A constant column counts as zero."""
        require_numeric(df, features)
        x = {f: F.nanvl(col(f).cast("double"), F.lit(None).cast("double")) for f in features}
        found = run_aggregates(df, {f"{k}{i}": a(x[f]) for i, f in enumerate(features) for k, a in (("m", F.avg), ("s", F.stddev_pop))})
        means = [float(found[f"m{i}"] or 0.0) for i in range(len(features))]
        spread = [float(found[f"s{i}"] or 0.0) for i in range(len(features))]
        return FourierMap(list(features), means, [1 / s if s > 0 else 0.0 for s in spread], 1 / len(features) if gamma is None else gamma, size, seed)

    def of(self, x: np.ndarray) -> np.ndarray:
        """rows x size."""
        weights, shifts = projection(self.seed, len(self.features), self.size)
        z = np.nan_to_num((x - np.array(self.means)) * np.array(self.scales), nan=0.0)
        return math.sqrt(2 / self.size) * np.cos(math.sqrt(2 * self.gamma) * (z @ weights.T) + shifts)

    def numbers(self) -> Column:
        return F.struct(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)])

    def column(self) -> Column:
        """The cosines as an array."""

        @F.pandas_udf("array<double>")
        def cosines(rows: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in rows:
                yield pd.Series(list(self.of(part.to_numpy(dtype=float))))

        return cosines(self.numbers())


@dataclass
class KernelModel:
    """Linear in the cosines: a number, or per class a value of which the largest decides."""

    map: dict[str, Any]
    coefficients: list[list[float]]
    intercepts: list[float]
    labels: list[Any] | None = None
    streams: bool = field(default=True, repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        fourier, weights, offsets = FourierMap(**self.map), np.array(self.coefficients).T, np.array(self.intercepts)
        classify = self.labels is not None

        @F.pandas_udf("double")
        def answer(rows: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in rows:
                values = fourier.of(part.to_numpy(dtype=float)) @ weights + offsets
                yield pd.Series(values.argmax(axis=1).astype(float) if classify else values[:, 0])

        said = answer(fourier.numbers())
        return df.withColumn(PREDICTION, decoded(said, self.labels) if classify else said)


def spread(train: DataFrame, size: int) -> DataFrame:
    """The rows in as many partitions as their cosines need at PART_BYTES each: a file's row group may hold a million rows."""
    parts = -(-train.count() * size * 8 // PART_BYTES)
    return train if parts <= 1 else train.repartition(max(parts, shuffle_width(train.sparkSession)))


def fit_kernel(
    train: DataFrame, features: Sequence[str], label: Column, estimator: Any, labels: list[Any] | None, gamma: float | None, size: int, seed: int, balanced: bool = False
) -> KernelModel:
    """Fit `estimator`, a linear one of pyspark.ml, on the cosines; of more than two classes one against the rest each.

    `label` is a number, or a class number; rows without one are left out. `balanced` weighs classes against their shares.
    """
    fourier = FourierMap.fit(train, features, gamma, size, seed)
    narrow = train.select(*[col(f) for f in dict.fromkeys(features)], label.cast("double").alias("__label")).where(F.col("__label").isNotNull())
    rows = spread(narrow, size).select(array_to_vector(fourier.column()).alias("__features"), "__label")
    rows = rows.persist()
    try:
        if labels is None:
            model = estimator.fit(rows)
            return KernelModel(vars(fourier), [model.coefficients.toArray().tolist()], [float(model.intercept)])
        counts = {int(r[0]): r[1] for r in rows.groupBy("__label").count().collect()}
        whole, weights, offsets = sum(counts.values()), [], []
        for c in range(len(labels)) if len(labels) > 2 else [1]:
            own = F.col("__label") == c
            n = counts.get(c, 0)
            if n in (0, whole):  # no other class to tell it from
                weights, offsets = [*weights, [0.0] * size], [*offsets, 1.0 if n else -1.0]
                continue
            weight = F.when(own, whole / (2 * n)).otherwise(whole / (2 * (whole - n))) if balanced else F.lit(1.0)
            model = estimator.fit(rows.select("__features", own.cast("double").alias("__label"), weight.alias("__w")))
            weights.append(model.coefficients.toArray().tolist())
            offsets.append(float(model.intercept))
        if len(labels) <= 2:  # the first class has the opposite value
            weights, offsets = ([[-w for w in weights[0]], weights[0]], [-offsets[0], offsets[0]]) if len(labels) == 2 else ([[0.0] * size], [0.0])
        return KernelModel(vars(fourier), weights, offsets, labels)
    finally:
        rows.unpersist()


def support_classifier(c: float, rows: int, rounds: int = 100) -> mc.LinearSVC:
    return mc.LinearSVC(featuresCol="__features", labelCol="__label", weightCol="__w", regParam=1 / (c * max(rows, 1)), maxIter=rounds, standardization=False)


def logistic_process(rounds: int = 100) -> mc.LogisticRegression:
    """The mean of a Gaussian process classifier: logistic loss with a unit prior on every cosine's weight."""
    return mc.LogisticRegression(featuresCol="__features", labelCol="__label", weightCol="__w", regParam=1e-4, maxIter=rounds, standardization=False)


def support_regressor(c: float, epsilon: float, rows: int, rounds: int = 100) -> mr.LinearRegression:
    """Errors count linearly beyond `epsilon` deviations, as a square within."""
    return mr.LinearRegression(
        featuresCol="__features", labelCol="__label", loss="huber", epsilon=max(1.0001, epsilon), regParam=1 / (max(c, 1e-6) * max(rows, 1)), maxIter=rounds, standardization=False
    )
