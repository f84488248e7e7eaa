"""Search over model families, scoring of batches, explanation of a fitted model."""

from __future__ import annotations

import json
import math
import random
import time
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import col, require, require_numeric
from ..operators.bins import Bin
from ..operators.rank import hash_rank
from ..operators.rows import sanitize_names
from ..plans.feature_step import FeatureChain
from ..plans.features import fe_apply
from ..plans.pipeline import Pipeline, PipelineModel
from . import metrics as mt
from .candidates import Family, classify_candidates, make_task, regress_candidates
from .models import PREDICTION, LinearModel, load_model, save_model
from .split import SEED, train_test_split
from .trees import shapley

# what a fit or a score may raise for its parameters or data; anything else is a fault of the program
FIT_ERRORS = (PySparkException, Py4JError, ValueError, ArithmeticError, np.linalg.LinAlgError)
GIVE_UP = 3  # failures after which a family is left out


class Ucb1:
    """Upper confidence bound choice (Auer et al. 2002): every arm once, then mean + sqrt(2 ln N / n).

    Scores of any scale are turned into rewards from 0 to 1 by their rank among all scores so far; a failure is 0.
    """

    def __init__(self, arms: Sequence[str]) -> None:
        self.scores: dict[str, list[float | None]] = {a: [] for a in arms}

    def _rewards(self) -> dict[str, list[float]]:
        known = sorted(s for seen in self.scores.values() for s in seen if s is not None)
        return {
            a: [0.0 if s is None else (bisect_left(known, s) + bisect_right(known, s)) / (2 * len(known)) for s in seen]
            for a, seen in self.scores.items()
        }

    def select(self) -> str:
        for arm, seen in self.scores.items():
            if not seen:
                return arm
        rewards = self._rewards()
        whole = sum(len(r) for r in rewards.values())
        return max(rewards, key=lambda a: sum(rewards[a]) / len(rewards[a]) + math.sqrt(2 * math.log(whole) / len(rewards[a])))

    def record(self, arm: str, score: float | None) -> None:
        """A larger score is better; None is a failure."""
        self.scores[arm].append(score)

    def drop(self, arm: str) -> None:
        self.scores.pop(arm, None)


@dataclass
class SearchResult:
    leaderboard: DataFrame
    models: dict[int, Any]
    failures: list[tuple[str, str, str]] = field(default_factory=list)  # family, parameters, error

    def best(self) -> Any:
        return self.models[self.leaderboard.select("run_id").first()[0]]

    def save(self, spark: SparkSession, path: str) -> None:
        """The leaderboard, every model and what failed, under one path of the shared store."""
        ranked = self.leaderboard.withColumn("place", F.row_number().over(W.orderBy(F.monotonically_increasing_id())))
        ranked.coalesce(1).write.mode("overwrite").parquet(f"{path}/leaderboard")
        failed = spark.createDataFrame(self.failures, "name string, hyper_param string, error string")
        failed.coalesce(1).write.mode("overwrite").parquet(f"{path}/failures")
        for run, model in self.models.items():
            save_model(spark, model, f"{path}/models/{run}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SearchResult":
        board = spark.read.parquet(f"{path}/leaderboard").orderBy("place").drop("place")
        models = {r["run_id"]: load_model(spark, f"{path}/models/{r['run_id']}") for r in board.select("run_id").collect()}
        return SearchResult(board, models, [tuple(r) for r in spark.read.parquet(f"{path}/failures").collect()])


def _score(scored: DataFrame, target: str, classify: bool, sensitive: str | None) -> dict[str, float]:
    if not classify:
        return mt.regression_metrics(scored, target, PREDICTION).first().asDict()
    out = mt.classification_metrics(scored, target, PREDICTION).first().asDict()
    if sensitive is not None:
        out |= mt.fairness_metrics(scored, target, PREDICTION, sensitive).first().asDict()
    return out


def automl_search(
    df: DataFrame,
    target: str,
    tuning_metric: str,
    n_passes: int = 50,
    test_split: float = 0.2,
    bias: bool = False,
    bias_column: str = "",
    key: Sequence[str] = (),
    families: Sequence[str] | None = None,
    seed: int = SEED,
) -> SearchResult:
    """Fit and score `n_passes` proposals and rank them by the tuning metric on the test part.

    The driver chooses family and parameters; every fit and every score is a distributed job over the
    stored training and test parts. `bias_column` names the sensitive column of fairness metrics.
    """
    metric = mt.CODES.get(tuning_metric, tuning_metric)
    classify = metric not in mt.REGRESSION
    if metric not in mt.DIRECTIONS:
        raise ValueError(f"unknown metric: {tuning_metric}")
    if bias != (metric in mt.FAIRNESS):
        raise ValueError("fairness metrics need bias=True, and bias=True needs a fairness metric")
    clean = sanitize_names(df)
    renamed = dict(zip(df.columns, clean.columns))
    require(df, [target, *key, *([bias_column] if bias else [])])
    target, key = renamed[target], [renamed[k] for k in key]
    sensitive = renamed[bias_column] if bias else None
    features = [c for c in clean.columns if c not in (target, *key)]
    features = [c for c in features if c != sensitive or _is_number(clean, c)]
    require_numeric(clean, features)
    known = classify_candidates() if classify else regress_candidates()
    pool: dict[str, Family] = {n: known[n] for n in (families or known)}

    train, test = train_test_split(clean, test_split, key, seed)
    train, test = train.persist(StorageLevel.MEMORY_AND_DISK), test.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        task = make_task(train, target, features, classify, seed)
        rng, chooser = random.Random(seed), Ucb1(list(pool))
        failures = dict.fromkeys(pool, 0)
        rows, models, failed = [], {}, []
        direction = 1.0 if mt.DIRECTIONS[metric] else -1.0
        run = 0
        while run < n_passes and chooser.scores:
            name = chooser.select()
            params = pool[name].propose(rng)
            try:
                began = time.time()
                model = pool[name].fit(task, params)
                took = time.time() - began
                scores = _score(model.transform(test), target, classify, sensitive)
                if scores[metric] is None:
                    raise ValueError(f"{metric} is undefined")
            except FIT_ERRORS as error:
                failed.append((name, json.dumps(params), f"{type(error).__name__}: {error}"))
                failures[name] += 1
                run += 1
                if failures[name] >= GIVE_UP:
                    chooser.drop(name)
                else:
                    chooser.record(name, None)
                if not chooser.scores and not rows:
                    raise RuntimeError("no family could be fitted") from error
                continue
            chooser.record(name, direction * scores[metric])
            names = (*mt.CLASSIFICATION, *(mt.FAIRNESS if bias else ())) if classify else mt.REGRESSION
            rows.append((name, *[None if scores[m] is None else float(scores[m]) for m in names], took, run, json.dumps(params)))
            models[run] = model
            run += 1
        columns = ", ".join(["name string", *[f"{m} double" for m in names], "tts double", "run_id int", "hyper_param string"])
        trials = df.sparkSession.createDataFrame(rows, columns)
        return SearchResult(mt.leaderboard(trials, metric), models, failed)
    finally:
        train.unpersist()
        test.unpersist()


def _is_number(df: DataFrame, column: str) -> bool:
    from ..functions.columns import data_type, is_numeric

    return is_numeric(data_type(df, column))


def fit_model(df: DataFrame, target: str, features: Sequence[str], family: str, classify: bool = False, **params: Any) -> Any:
    """One family with given parameters."""
    known = classify_candidates() if classify else regress_candidates()
    return known[family].fit(make_task(df, target, features, classify), params)


def batch_score(df: DataFrame, steps: Sequence[PipelineModel | FeatureChain], model: Any) -> DataFrame:
    """Replay fitted steps, oldest first, then predict. No job runs, so a stream may be passed as well."""
    for step in steps:
        df = step.transform(df, drop_rows=False) if isinstance(step, PipelineModel) else fe_apply(df, step)
    return model.transform(df)


def _quality(scored: DataFrame, target: str, classify: bool) -> float:
    return _score(scored, target, classify, None)["accuracy" if classify else "R2"]


def global_importance(
    model: Any,
    df: DataFrame,
    features: Sequence[str],
    k: int = 5,
    target: str | None = None,
    key: Sequence[str] = (),
    classify: bool = False,
    seed: int = SEED,
    by: str = "permutation",
) -> DataFrame:
    """(feature, importance) of the k most important features over all rows.

    A linear model is explained exactly: mean absolute contribution b·(x - mean). Any other model by how
    much its score falls when one column is permuted (Breiman 2001); one join of the rows to themselves at
    hash positions gives the permuted values of all columns. With `by="shapley"` a model of trees is explained by the mean
    absolute Shapley value of each feature, in one pass.
    """
    require(df, features)
    if by == "shapley" and not isinstance(model, LinearModel):
        told = shapley(model, df)
        sums = told.agg(*[F.avg(F.abs(F.col("contributions")[i])) for i in range(len(model.features))]).first()
        found = [(f, float(v or 0.0)) for f, v in zip(model.features, sums) if f in features]
    elif isinstance(model, LinearModel):
        weights = dict(zip(model.features, model.coefficients))
        means = df.agg(*[F.avg(col(f)) for f in features]).first()
        wide = df.agg(
            *[F.avg(F.abs(F.lit(weights.get(f, 0.0)) * (col(f) - F.lit(float(m or 0.0))))) for f, m in zip(features, means)]
        ).first()
        found = [(f, float(v or 0.0)) for f, v in zip(features, wide)]
    else:
        require(df, [target, *key])
        base = _quality(model.transform(df), target, classify)
        here = hash_rank(df, [], key, seed, "__pos")
        there = hash_rank(df.select(*dict.fromkeys([*key, *features])), [], key, seed + 1, "__pos")
        mixed = here.join(there.select("__pos", *[col(f).alias(f"__p{i}") for i, f in enumerate(features)]), "__pos")
        mixed = mixed.persist(StorageLevel.MEMORY_AND_DISK)
        found = []
        for i, f in enumerate(features):
            changed = mixed.withColumn(f, F.col(f"__p{i}")).select(*[col(c) for c in df.columns])
            found.append((f, float(base - _quality(model.transform(changed), target, classify))))
        mixed.unpersist()
    found.sort(key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame(found[:k], "feature string, importance double")


def dependence_data(
    model: Any, df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), top: int = 5, bins: int = 10, **options: Any
) -> DataFrame:
    """Per row and top feature: (keep, feature, value, contribution, other, other_value).

    The contribution is b·(x - mean) of a linear model, with `by="shapley"` the row's Shapley value of a model of trees, else
    the mean prediction of the value's bin less the mean of all. `other` is the strongest other feature.
    """
    ranked = [r["feature"] for r in global_importance(model, df, features, len(features), **options).collect()]
    chosen = ranked[:top]
    partner = {f: next((g for g in ranked if g != f), f) for f in chosen}
    if isinstance(model, LinearModel):
        weights = dict(zip(model.features, model.coefficients))
        means = df.agg(*[F.avg(col(f)) for f in chosen]).first()
        effects: dict[str, Column] = {
            f: F.lit(weights.get(f, 0.0)) * (col(f) - F.lit(float(m or 0.0))) for f, m in zip(chosen, means)
        }
        rows = df
    elif options.get("by") == "shapley":
        rows = shapley(model, df, df.columns)
        effects = {f: F.col("contributions")[model.features.index(f)] for f in chosen}
    else:
        scored = model.transform(df)
        binned = Pipeline([Bin(f, "kbins", bins) for f in chosen]).fit(df)
        codes = {f: binned.step(f, "bin_variables").expression(col(f)) for f in chosen}
        whole = scored.agg(F.avg(PREDICTION)).first()[0]
        rows, effects = df, {}
        for f in chosen:
            per_bin = {r["b"]: r["m"] for r in scored.groupBy(codes[f].alias("b")).agg(F.avg(PREDICTION).alias("m")).collect()}
            effect = F.when(F.lit(False), F.lit(0.0))
            for b, m in per_bin.items():
                if b is not None:
                    effect = effect.when(codes[f] == b, F.lit(float(m - whole)))
            effects[f] = effect
    lines = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                col(f).cast("double").alias("value"),
                effects[f].alias("contribution"),
                F.lit(partner[f]).alias("other"),
                col(partner[f]).cast("double").alias("other_value"),
            )
            for f in chosen
        ]
    )
    return rows.select(*[col(c) for c in keep], F.inline(lines))
