"""Variance inflation, collinear columns, principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, numeric_columns, total
from ..functions.gram import DRIVER_COLUMNS, covariance, gram_matrix, top_components
from ..plans.feature_step import FeatureStep, register_feature_step

NULL_SHARE = 1e-13  # of the largest eigenvalue: below, a direction counts as empty
NULL_PART = 1e-6  # of a column's unit length in the empty directions


def inflation(gram: np.ndarray) -> np.ndarray:
    """VIF without intercept from X'X: G_ii times the i-th diagonal of its inverse.

    Infinite for the columns that are a combination of others, so those with a part in the null space; for the others the
    pseudo-inverse gives what the inverse would without the superfluous columns.
    """
    if len(gram) == 1:
        return np.ones(1)
    size = np.sqrt(np.diag(gram))
    out = np.full(len(gram), np.inf)
    live = np.flatnonzero(size > 0)
    if not len(live):
        return out
    unit = gram[np.ix_(live, live)] / np.outer(size[live], size[live])
    values, vectors = np.linalg.eigh(unit)
    null = values < values.max() * NULL_SHARE
    inside = np.sqrt((vectors[:, null] ** 2).sum(axis=1)) > NULL_PART
    inverse = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1)
    out[live] = np.where(inside, np.inf, inverse)
    return out


def vif_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, vif) of the numeric columns, from one pass over the table."""
    names = list(columns or numeric_columns(df))
    scores = inflation(gram_matrix(df, names))
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, scores)], "feature string, vif double")


def noncollinear(gram: np.ndarray, names: Sequence[str], threshold: float) -> list[tuple[str, float]]:
    """Drop the column with the largest VIF until all are below the threshold; one column always stays."""
    if threshold <= 0:
        raise ValueError("VIF threshold must be positive")
    left = list(range(len(names)))
    scores = inflation(gram)
    while len(left) > 1 and scores.max() >= threshold:
        del left[int(scores.argmax())]
        scores = inflation(gram[np.ix_(left, left)])
    order = np.argsort(scores, kind="stable")
    return [(names[left[i]], float(scores[i])) for i in order]


def collinear_report(df: DataFrame, vif_value: float, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, vif, position) of the columns that stay."""
    names = list(columns or numeric_columns(df))
    kept = noncollinear(gram_matrix(df, names), names, vif_value)
    rows = [(n, v, i) for i, (n, v) in enumerate(kept)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, position int")


def drop_collinear(df: DataFrame, vif_value: float, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns that are not collinear, in ascending VIF order; `keep` is carried along."""
    names = [c for c in numeric_columns(df) if c not in keep]
    kept = noncollinear(gram_matrix(df, names), names, vif_value)
    return df.select(*[col(c) for c in [*[n for n, _ in kept], *keep]])


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, loadings by row) of the k leading components; the largest loading is positive."""
    if not 0 < k <= len(cov):
        raise ValueError("number of components must lie between 1 and the number of columns")
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    loadings = vectors[:, order].T
    signs = np.sign(loadings[np.arange(k), np.abs(loadings).argmax(axis=1)])
    return values[order], loadings * signs[:, None]


def project(df: DataFrame, columns: Sequence[str], means: Sequence[float], loadings: Sequence[Sequence[float]], carried: Sequence[str]) -> DataFrame:
    scores = [
        total((col(c).cast("double") - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(columns, means, row)).alias(str(i))
        for i, row in enumerate(loadings)
    ]
    return df.select(*scores, *[col(c) for c in carried])


def pca(df: DataFrame, n_components: int, columns: Sequence[str] | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Columns 0 … k-1: centred data on its principal components."""
    names = list(columns or [c for c in numeric_columns(df) if c not in carried])
    means, loadings = _axes(df, names, n_components)
    return project(df, names, means, loadings, carried)


def _axes(df: DataFrame, names: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, loadings by row) from the covariance, or without it where it would not fit the driver."""
    if len(names) > DRIVER_COLUMNS:
        means, _, loadings = top_components(df, names, k)
        return means, loadings
    _, means, cov = covariance(df, names)
    return means, components(cov, k)[1]


@register_feature_step
class CollinearStep(FeatureStep):
    kind = "multiCollinearity"

    def __init__(self, vif_Value: float, carried: Sequence[str] = ()) -> None:
        super().__init__(vif_Value=float(vif_Value), carried=list(carried))
        if self.params["vif_Value"] <= 0:
            raise ValueError("VIF threshold must be positive")

    def fit(self, df: DataFrame) -> None:
        names = [c for c in numeric_columns(df) if c not in self.params["carried"]]
        self.state = {"columns": [n for n, _ in noncollinear(gram_matrix(df, names), names, self.params["vif_Value"])]}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[col(c) for c in [*self.state["columns"], *self.params["carried"]] if c in df.columns])


@register_feature_step
class PcaStep(FeatureStep):
    kind = "PCA"

    def __init__(self, n_Components: int, carried: Sequence[str] = ()) -> None:
        super().__init__(n_Components=int(n_Components), carried=list(carried))

    def fit(self, df: DataFrame) -> None:
        names = [c for c in df.columns if c not in self.params["carried"]]
        means, loadings = _axes(df, names, self.params["n_Components"])
        self.state = {"columns": names, "means": means.tolist(), "loadings": loadings.tolist()}

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        return project(df, s["columns"], s["means"], s["loadings"], [c for c in self.params["carried"] if c in df.columns])
