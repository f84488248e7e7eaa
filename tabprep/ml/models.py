"""Fitted models: each adds a `prediction` column to a frame."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from importlib import import_module
from typing import Any

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import col, data_type, total
from ..operators.neighbors import knn_join

PREDICTION = "prediction"


def decoded(index: Column, labels: Sequence[Any]) -> Column:
    """Class number back to the class."""
    return F.element_at(F.array(*[F.lit(v) for v in labels]), index.cast("int") + 1)


def index_of(column: Column, labels: Sequence[Any]) -> Column:
    """Class number of a class as double; NULL for a class not seen in training."""
    out = F.when(F.lit(False), F.lit(0.0))
    for i, v in enumerate(labels):
        out = out.when(column == F.lit(v), F.lit(float(i)))
    return out


@dataclass
class LinearModel:
    """intercept + sum of coefficient times feature, as one expression."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    streams: bool = field(default=True, repr=False)

    def value(self) -> Column:
        terms = [F.lit(b) * col(f).cast("double") for f, b in zip(self.features, self.coefficients)]
        return total([F.lit(self.intercept), *terms])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, self.value())

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "coefficients": self.coefficients, "intercept": self.intercept})

    @staticmethod
    def from_json(text: str) -> "LinearModel":
        return LinearModel(**json.loads(text))


@dataclass
class ScoreModel:
    """The class with the largest score: constant + weights · x - (x - centre)' form (x - centre) / 2, numbers per class."""

    features: list[str]
    labels: list[Any]
    constants: list[float]
    weights: list[list[float]]
    centres: list[list[float]]
    forms: list[list[list[float]]] | None = None
    streams: bool = True

    def score(self, i: int) -> Column:
        terms = [F.lit(self.constants[i])]
        x = [col(f).cast("double") for f in self.features]
        terms += [F.lit(w) * v for w, v in zip(self.weights[i], x) if w]
        if self.forms:
            off = [v - F.lit(m) for v, m in zip(x, self.centres[i])]
            form = self.forms[i]
            for j in range(len(x)):
                terms += [F.lit(-form[j][k] / (2 if j == k else 1)) * off[j] * off[k] for k in range(j, len(x))]
        return total(terms)

    def transform(self, df: DataFrame) -> DataFrame:
        scores = F.array(*[self.score(i) for i in range(len(self.labels))])
        best = F.array_position(scores, F.array_max(scores)) - 1
        return df.withColumn(PREDICTION, decoded(best, self.labels))


@dataclass
class BoostedModel:
    """Weighted trees: the class with the most weight, or the weighted median of the trees' values."""

    features: list[str]
    trees: list[Any]
    weights: list[float]
    labels: list[Any] | None = None
    streams: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        out = VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep").transform(df)
        for i, tree in enumerate(self.trees):
            made = tree.transform(out)
            out = made.select(*[col(c) for c in out.columns], F.col(PREDICTION).alias(f"__t{i}"))
        votes = [F.struct(F.col(f"__t{i}").alias("p"), F.lit(w).alias("w")) for i, w in enumerate(self.weights)]
        if self.labels is not None:
            sums = F.array(*[total([F.when(v["p"] == float(c), v["w"]).otherwise(0.0) for v in votes]) for c in range(len(self.labels))])
            answer = decoded(F.array_position(sums, F.array_max(sums)) - 1, self.labels)
        else:
            ordered = F.array_sort(F.array(*votes))
            half = sum(self.weights) / 2
            start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("p"))

            def passed(state: Column, vote: Column) -> Column:
                w = state["w"] + vote["w"]
                return F.struct(w.alias("w"), F.coalesce(state["p"], F.when(w >= half, vote["p"])).alias("p"))

            answer = F.aggregate(ordered, start, passed)["p"]
        return out.withColumn(PREDICTION, answer).drop("__features", *[f"__t{i}" for i in range(len(self.trees))])


@dataclass
class MlModel:
    """A fitted pyspark.ml model; class numbers are turned back into classes."""

    features: list[str]
    model: Any
    labels: list[Any] | None = None
    streams: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        rows = VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep").transform(df)
        out = self.model.transform(rows)
        made = [c for c in out.columns if c not in df.columns and c != PREDICTION]
        if self.labels is not None:
            out = out.withColumn(PREDICTION, decoded(F.col(PREDICTION), self.labels))
        return out.drop(*made)


@dataclass
class NeighbourModel:
    """Vote or mean of the k nearest training rows, found by the exact neighbour join, or in `layered` cells of a layered index.

    A row with a gap in a feature has no neighbours: its prediction is null; training rows with a gap have no vote.
    """

    train: DataFrame
    features: list[str]
    target: str
    k: int
    by_distance: bool
    classify: bool
    streams: bool = False
    layered: int | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        key, keyed = "__row", df.withColumn("__row", _row_key(df))
        # rows alike in every column share their key and their answer
        asked = keyed.select(key, *[col(f) for f in self.features]).dropDuplicates([key])
        offered = self._votes(key)
        near = knn_join(asked, offered, self.features, self.k, key, exclude_same=False, carry=self.target, layered=self.layered)
        votes = near.withColumn("__y", F.col("carry").cast(data_type(self.train, self.target)))
        exact = F.max(F.col("distance") == 0).over(W.partitionBy(key)) if self.by_distance else None
        weight = F.lit(1.0)
        if self.by_distance:
            # rows at distance zero, if any, decide alone
            weight = F.when(F.col("distance") == 0, 1.0).when(exact, 0.0).otherwise(1.0 / F.col("distance"))
        votes = votes.withColumn("__w", weight)
        if self.classify:
            tally = votes.groupBy(key, "__y").agg(F.sum("__w").alias("__w"))
            answer = tally.groupBy(key).agg(F.min_by("__y", F.struct(-F.col("__w"), F.col("__y"))).alias(PREDICTION))
        else:
            answer = votes.groupBy(key).agg((F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")).alias(PREDICTION))
        return keyed.join(answer, key, "left").drop(key)

    def _votes(self, key: str) -> DataFrame:
        """Training rows; of rows alike in every column as many as can be among the k nearest, each with a key of its own."""
        train = self.train.select(*[col(f) for f in self.features], col(self.target))
        alike = train.withColumn(key, _row_key(train)).groupBy(key)
        rows = alike.agg(*[F.first(col(c)).alias(c) for c in train.columns], F.count(F.lit(1)).alias("__n"))
        rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least("__n", F.lit(self.k)).cast("int"))))
        return rows.withColumn(key, F.concat_ws("-", key, F.col("__copy").cast("string"))).drop("__n", "__copy")


def _row_key(df: DataFrame) -> Column:
    """128 hash bits of the whole row as text."""
    return F.md5(F.to_json(F.struct(*[col(c) for c in df.columns])))


def probability(df: DataFrame, column: str = "probability", index: int = 1) -> Column:
    return vector_to_array(F.col(column))[index]


def bayesian_ridge(
    gram: np.ndarray, xy: np.ndarray, yy: float, n: int, alpha_1: float, alpha_2: float, lambda_1: float, lambda_2: float, rounds: int = 300
) -> np.ndarray:
    """Evidence iteration (MacKay 1992; Tipping 2001) on centred cross products."""
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ xy
    alpha, lam = (n / yy if yy > 0 else 1.0), 1.0
    beta = np.zeros(len(xy))
    for _ in range(rounds):
        new = vectors @ (rotated / (values + lam / alpha))
        rss = max(yy - 2 * new @ xy + new @ gram @ new, 0.0)
        used = float((alpha * values / (lam + alpha * values)).sum())
        lam = (used + 2 * lambda_1) / (new @ new + 2 * lambda_2)
        alpha = (n - used + 2 * alpha_1) / (rss + 2 * alpha_2)
        if np.abs(new - beta).sum() < 1e-3:
            return new
        beta = new
    return beta


def relevance(
    gram: np.ndarray, xy: np.ndarray, yy: float, n: int, threshold: float, alpha_1: float, alpha_2: float, lambda_1: float, lambda_2: float, rounds: int = 300
) -> np.ndarray:
    """Automatic relevance determination (MacKay 1994): every coefficient has a precision; beyond `threshold` it is 0."""
    p = len(xy)
    lam, alpha, beta = np.ones(p), (n / yy if yy > 0 else 1.0), np.zeros(p)
    for _ in range(rounds):
        live = np.flatnonzero(lam < threshold)
        new = np.zeros(p)
        if not len(live):
            return new
        spread = np.linalg.pinv(alpha * gram[np.ix_(live, live)] + np.diag(lam[live]))
        new[live] = alpha * spread @ xy[live]
        rss = max(yy - 2 * new @ xy + new @ gram @ new, 0.0)
        sure = 1 - lam[live] * np.diag(spread)
        lam[live] = (sure + 2 * lambda_1) / (new[live] ** 2 + 2 * lambda_2)
        alpha = (n - sure.sum() + 2 * alpha_1) / (rss + 2 * alpha_2)
        if np.abs(new - beta).sum() < 1e-3:
            return new
        beta = new
    return beta


def least_angle(gram: np.ndarray, xy: np.ndarray, alpha: float, lasso: bool, eps: float) -> np.ndarray:
    """Least angle regression (Efron et al. 2004) on mean cross products, until no correlation exceeds `alpha`.

    The coefficients in play move so that their columns' correlations with the residual fall alike; the next column joins
    when it is as correlated. With `lasso` a coefficient that reaches 0 leaves again.
    """
    p = len(xy)
    beta, active, left = np.zeros(p), [], -1
    tiny = 1e-10 * max(np.abs(xy).max(initial=0.0), 1e-300)
    for _ in range(8 * p + 8):
        c = xy - gram @ beta
        rest = [j for j in range(p) if j not in active and j != left and gram[j, j] > 0]
        top = max((abs(c[j]) for j in [*active, *rest]), default=0.0)
        if top <= max(alpha, tiny):
            break
        if left < 0:
            joins = [j for j in rest if abs(c[j]) >= top * (1 - 1e-9)]
            active += joins[:1] if active else [max(rest, key=lambda j: abs(c[j]))]
            rest = [j for j in rest if j not in active]
        left = -1
        sign = np.sign(c[active])
        w = np.linalg.pinv(gram[np.ix_(active, active)] + eps * 1e-6 * np.eye(len(active))) @ sign
        a = gram[:, active] @ w
        steps = [top - alpha]
        for j in rest:
            steps += [s for s in ((top - c[j]) / (1 - a[j]) if a[j] != 1 else -1, (top + c[j]) / (1 + a[j]) if a[j] != -1 else -1) if s > tiny]
        step = min(steps)
        if lasso:
            zero = [(-beta[j] / v, j) for j, v in zip(active, w) if v and 0 < -beta[j] / v < step]
            if zero:
                step, left = min(zero)
        beta[active] += step * w
        if left >= 0:
            beta[left] = 0.0
            active.remove(left)
    return beta


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """Write any fitted model under a path of the shared store; `load_model` gives it back in any session."""
    values = {f.name: getattr(model, f.name) for f in fields(model) if f.name not in ("model", "trees", "train")}
    saved: dict[str, Any] = {"kind": type(model).__name__, "values": values}
    parts = [model.model] if isinstance(model, MlModel) else model.trees if isinstance(model, BoostedModel) else []
    for i, part in enumerate(parts):
        part.write().overwrite().save(f"{path}/part{i}")
    saved["parts"] = [[type(part).__module__, type(part).__name__] for part in parts]
    if isinstance(model, NeighbourModel):
        model.train.write.mode("overwrite").parquet(f"{path}/train")
    spark.createDataFrame([(json.dumps(saved),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Any:
    from .kernels import KernelModel
    from .trees import TreeModel

    saved = json.loads(spark.read.text(f"{path}/model").first()[0])
    kind = {c.__name__: c for c in (LinearModel, ScoreModel, MlModel, NeighbourModel, BoostedModel, TreeModel, KernelModel)}[saved["kind"]]
    parts = [getattr(import_module(m), n).load(f"{path}/part{i}") for i, (m, n) in enumerate(saved["parts"])]
    more: dict[str, Any] = {}
    if kind is MlModel:
        more["model"] = parts[0]
    elif kind is BoostedModel:
        more["trees"] = parts
    elif kind is NeighbourModel:
        more["train"] = spark.read.parquet(f"{path}/train")
    return kind(**saved["values"], **more)
