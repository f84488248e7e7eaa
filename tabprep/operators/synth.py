"""Generated rows, noise, and comparison with the original.

The generator is a linear latent-variable model, probabilistic PCA (Tipping & Bishop 1999): Spark
fits mean and covariance, the driver decomposes a small matrix, and the tasks draw latent values and decode them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col, data_type, numeric_columns, require, require_numeric, total
from ..functions.gram import EXPRESSION_COLUMNS, covariance
from ..functions.hashing import gauss
from ..ml.split import train_test_split
from ..plans.pipeline import Pipeline, PipelineModel
from .balance import draws, held_counts
from .encode import Encode
from .scale import Scale

LATENT = 5  # width of the latent space
NOISE = 0.05


def multiplicative_noise(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], mu: float = 0.0, sigma: float = NOISE, seed: int = 5
) -> DataFrame:
    """Every cell times 1 + N(mu, sigma), drawn from the key and the column's name."""
    require_numeric(df, columns)
    require(df, key)
    made = {
        c: col(c) * (F.lit(1.0 + mu) + F.lit(float(sigma)) * gauss(seed, *[col(k) for k in key], F.lit(c))) for c in columns
    }
    return df.withColumns(made)


@dataclass
class Standardized:
    """Both parts on the training part's scale, and the scale itself."""

    train: DataFrame
    test: DataFrame
    model: PipelineModel

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({s.column: s.inverse(col(s.column)) for s in self.model.steps})


def standardize_split(
    df: DataFrame, columns: Sequence[str], key: Sequence[str], test_size: float = 0.2, seed: int = 42
) -> Standardized:
    """Hash split, then standard scaling learned from the training part."""
    train, test = train_test_split(df, test_size, key, seed)
    model = Pipeline([Scale(c, "standardscaler") for c in columns]).fit(train)
    names = [col(c) for c in df.columns]
    return Standardized(model.transform(train).select(*names), model.transform(test).select(*names), model)


@dataclass
class Latent:
    """x = mean + loadings z + sigma e, one per group."""

    means: np.ndarray
    loadings: np.ndarray
    sigma: float

    @staticmethod
    def fit(means: np.ndarray, cov: np.ndarray, width: int = LATENT) -> "Latent":
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1]
        values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
        q = min(width, len(values))
        rest = values[q:]
        noise = float(rest.mean()) if len(rest) else 0.0
        # the sign of a vector is arbitrary; the largest loading is made positive
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        return Latent(means, (vectors * signs)[:, :q] * np.sqrt(np.maximum(values[:q] - noise, 0.0)), noise**0.5)


def _group_moments(df: DataFrame, columns: Sequence[str], target: str | None, classes: Sequence[Any]) -> dict[Any, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance per class in one pass (or per class for very wide tables)."""
    p = len(columns)
    if target is None:
        _, means, cov = covariance(df, columns)
        return {None: (means, cov)}
    if p > EXPRESSION_COLUMNS:
        return {c: covariance(df.where(col(target) == F.lit(c)), columns)[1:] for c in classes}
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = (
        df.where(col(target).isin(*classes))
        .select(col(target).alias("__g"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
        .na.drop()
        .groupBy("__g")
        .agg(*[F.avg(f"x{i}") for i in range(p)], *[F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs])
        .collect()
    )
    out = {}
    for r in rows:
        cov = np.zeros((p, p))
        for (i, j), v in zip(pairs, r[p + 1 :]):
            cov[i, j] = cov[j, i] = v or 0.0
        out[r[0]] = (np.array([v or 0.0 for v in r[1 : p + 1]]), cov)
    return out


def _prepared(df: DataFrame, target: str | None, skip: Sequence[str]) -> tuple[DataFrame, list[str], dict[str, Encode], dict[str, Scale]]:
    """Text columns as codes, everything on a standard scale."""
    names = [c for c in df.columns if c != target and c not in skip]
    numeric = set(numeric_columns(df))
    coded = Pipeline([Encode(c) for c in names if c not in numeric]).fit(df)
    table = coded.transform(df).select(*[col(c) for c in df.columns])
    scaled = Pipeline([Scale(c, "standardscaler") for c in names]).fit(table)
    return (
        scaled.transform(table).select(*[col(c) for c in df.columns]),
        names,
        {s.column: s for s in coded.steps},
        {s.column: s for s in scaled.steps},
    )


def _generate(df: DataFrame, target: str | None, need: dict[Any, int], skip: Sequence[str], seed: int) -> DataFrame:
    table, names, encoders, scales = _prepared(df, target, skip)
    spark = df.sparkSession
    if target is None:
        (moments,) = _group_moments(table, names, None, []).values()
        models = {"": Latent.fit(*moments)}
        group, kind = "__g", "string"
        picks = spark.range(1, need[None] + 1).select(F.lit("").alias(group), F.col("id").alias("j"))
    else:
        live = [c for c, n in need.items() if n > 0]
        models = {c: Latent.fit(*m) for c, m in _group_moments(table, names, target, live).items()}
        group, kind = target, data_type(df, target).simpleString()
        picks = draws(spark, need, target, data_type(df, target))
    width = max(m.loadings.shape[1] for m in models.values())
    latent = picks.withColumns({f"__z{q}": gauss(f"{seed}z{q}", col(group), F.col("j")) for q in range(width)})
    if len(models) == 1:
        (only,) = models.values()
        numbers = {"__m": F.lit(only.means.tolist()), "__w": F.lit(only.loadings.tolist()), "__s": F.lit(only.sigma)}
        latent = latent.withColumns(numbers)
    else:
        # one row of numbers per class: classes are bounded, so the table is small
        rows = [(c, m.means.tolist(), m.loadings.tolist(), m.sigma) for c, m in models.items()]
        held = spark.createDataFrame(rows, f"`{group}` {kind}, __m array<double>, __w array<array<double>>, __s double")
        latent = latent.join(F.broadcast(held), group)
    noisy = any(m.sigma > 0 for m in models.values())
    out = {}
    for i, name in enumerate(names):
        terms = [F.col("__m")[i], *[F.col("__w")[i][q] * F.col(f"__z{q}") for q in range(width)]]
        if noisy:
            terms.append(F.col("__s") * gauss(f"{seed}e{i}", col(group), F.col("j")))
        value = scales[name].inverse(total(terms))
        if name in encoders:
            value = encoders[name].decode(value)
        elif isinstance(data_type(df, name), T.IntegralType):
            value = F.round(value).cast(data_type(df, name))
        out[name] = value
    return latent.select(
        *[
            out[c].alias(c) if c in out else col(c) if c == target else F.lit(None).cast(df.schema[c].dataType).alias(c)
            for c in df.columns
        ]
    )


def synthesize_class(df: DataFrame, target: str, seed: int = 5, skip: Sequence[str] = ()) -> DataFrame:
    """All rows, and generated rows that fill every class up to the largest; `skip` columns are NULL there."""
    counts = held_counts(df, target)
    most = max(counts.values())
    need = {c: most - n for c, n in counts.items()}
    if not any(need.values()):
        return df
    return df.unionByName(_generate(df, target, need, skip, seed))


def synthesize_rows(df: DataFrame, no_of_samples: int = 200, seed: int = 5, skip: Sequence[str] = ()) -> DataFrame:
    """All rows and `no_of_samples` generated ones."""
    if no_of_samples < 1:
        return df
    return df.unionByName(_generate(df, None, {None: int(no_of_samples)}, skip, seed))


def distribution_compare(original: DataFrame, generated: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, origin, mean, n) of the numeric columns of both tables."""
    names = list(columns or [c for c in numeric_columns(original) if c in generated.columns])
    require_numeric(original, names)
    parts = []
    for origin, df in (("original", original), ("generated", generated)):
        wide = df.agg(*[x for i, n in enumerate(names) for x in (F.avg(col(n)).alias(f"m{i}"), F.count(col(n)).alias(f"n{i}"))])
        rows = F.array(
            *[
                F.struct(F.lit(n).alias("column"), F.lit(origin).alias("origin"), F.col(f"m{i}").alias("mean"), F.col(f"n{i}").alias("n"))
                for i, n in enumerate(names)
            ]
        )
        parts.append(wide.select(F.inline(rows)))
    return parts[0].unionByName(parts[1])
