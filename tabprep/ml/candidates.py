"""Model families with their parameter ranges, and how each is fitted on Spark."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml import classification as mc, regression as mr
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, total
from ..functions.gram import covariance
from ..functions.hashing import uniform
from ..functions.quantiles import exact_quantiles
from ..operators.synth import _group_moments
from ..plans.pipeline import run_aggregates
from ..session import pinned
from .kernels import SIZE, KernelModel, fit_kernel, logistic_process, support_classifier, support_regressor
from .models import BoostedModel, LinearModel, MlModel, NeighbourModel, ScoreModel, bayesian_ridge, index_of, least_angle, relevance
from .trees import ExtraTrees, TreeModel


@dataclass(frozen=True)
class Whole:
    low: int
    high: int
    step: int = 1

    def draw(self, rng: random.Random) -> int:
        return rng.randrange(self.low, self.high + 1, self.step)


@dataclass(frozen=True)
class Real:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class Choice:
    options: tuple[Any, ...]

    def draw(self, rng: random.Random) -> Any:
        return rng.choice(self.options)


YES_NO = Choice((True, False))

# fixed values: parameter ranges per family, those that a Spark estimator has
CLASSIFICATION_SPACES: dict[str, dict[str, Any]] = {
    "DTC": {
        "max_depth": Whole(1, 16),
        "min_samples_leaf": Choice((2, 3, 4, 5, 6)),
        "criterion": Choice(("gini", "entropy")),
        "min_impurity_decrease": Real(0.01, 0.5),
    },
    "rf": {
        "n_estimators": Whole(10, 300, 10),
        "max_depth": Whole(1, 11),
        "min_impurity_decrease": Real(0.01, 0.5),
        "max_features": Choice(("sqrt", "log2")),
        "bootstrap": YES_NO,
    },
    "bagging": {"bootstrap": YES_NO, "max_features": Real(0.4, 1), "max_samples": Real(0.4, 1)},
    "gbt": {
        "learning_rate": Real(0.00001, 0.5),
        "n_estimators": Whole(10, 300, 10),
        "subsample": Real(0.2, 1),
        "max_depth": Whole(1, 11),
        "colsample_bytree": Real(0.5, 1),
    },
    "LogReg": {"max_iter": Whole(1, 5000), "C": Real(1e-3, 100)},
    "ridge": {"alpha": Real(0.001, 10)},
    "SGDC": {"max_iter": Whole(1, 5000), "tol": Real(1e-3, 1)},
    "svc": {"C": Real(0.001, 100), "class_weight": Choice(("balanced",))},
    "gaussian_process": {"max_iter_predict": Whole(100, 1000, 100)},
    "gnb": {},
    "quadratic_discriminant": {"reg_param": Real(0, 1)},
    "linear_discriminant": {
        "shrinkage": Choice(
            ("empirical", 0.0001, 0.001, 0.01, 0.0005, 0.005, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1)
        )
    },
    "knn": {"n_neighbors": Whole(1, 51), "weights": Choice(("uniform", "distance"))},
    "ada": {"n_estimators": Whole(50, 250, 50), "learning_rate": Real(0.05, 2)},
    "extra_trees": {
        "n_estimators": Whole(10, 300, 10),
        "criterion": Choice(("gini", "entropy")),
        "max_depth": Whole(1, 11),
        "min_impurity_decrease": Real(0, 0.5),
        "max_features": Choice(("sqrt", "log2")),
        "bootstrap": YES_NO,
        "min_samples_split": Choice((2, 5, 7, 9, 10)),
        "min_samples_leaf": Whole(2, 6),
    },
}
REGRESSION_SPACES: dict[str, dict[str, Any]] = {
    "linreg": {"fit_intercept": YES_NO, "normalize": YES_NO},
    "lassoreg": {"alpha": Real(0.01, 10), "fit_intercept": YES_NO, "normalize": YES_NO},
    "ridgereg": {"alpha": Real(0.01, 10), "fit_intercept": YES_NO, "normalize": YES_NO},
    "elastic": {"alpha": Real(0.01, 10), "l1_ratio": Real(0.01, 1), "fit_intercept": YES_NO, "normalize": YES_NO},
    "gradBoost": {
        "n_estimators": Whole(10, 300, 10),
        "learning_rate": Real(0.00001, 0.5),
        "subsample": Real(0.2, 1),
        "min_samples_leaf": Whole(1, 5),
        "max_depth": Whole(1, 11),
        "min_impurity_decrease": Real(0.00001, 0.5),
        "max_features": Choice(("sqrt", "log2")),
    },
    "rf": {
        "n_estimators": Whole(10, 300, 10),
        "max_depth": Whole(1, 11),
        "min_impurity_decrease": Real(0.0001, 0.5),
        "max_features": Choice(("sqrt", "log2")),
        "bootstrap": YES_NO,
    },
    "dtr": {
        "max_depth": Whole(1, 16),
        "min_samples_leaf": Whole(2, 6),
        "min_impurity_decrease": Real(0.0001, 0.5),
    },
    "knn": {"n_neighbors": Whole(1, 51), "weights": Choice(("uniform", "distance"))},
    "huber": {"epsilon": Real(1, 1.9), "alpha": Real(0.000001, 0.9), "fit_intercept": YES_NO},
    "bayesian_ridge": {
        "alpha_1": Real(0.0000001, 0.3),
        "alpha_2": Real(0.0000001, 0.3),
        "lambda_1": Real(0.0000001, 0.3),
        "lambda_2": Real(0.0000001, 0.3),
        "fit_intercept": YES_NO,
    },
    "ard": {
        "alpha_1": Real(0.000001, 0.3),
        "alpha_2": Real(0.000001, 0.3),
        "lambda_1": Real(0.0000001, 0.3),
        "lambda_2": Real(0.0000001, 0.3),
        "threshold_lambda": Whole(5000, 60000, 5000),
        "fit_intercept": YES_NO,
    },
    "lars": {"eps": Real(0.0001, 0.1)},
    "lassolars": {"fit_intercept": YES_NO, "alpha": Real(0.00001, 0.9), "eps": Real(0.0001, 0.1)},
    "adaBoost": {
        "n_estimators": Whole(10, 300, 10),
        "learning_rate": Real(0.00001, 0.5),
        "loss": Choice(("linear", "square", "exponential")),
    },
    "ransac": {"min_samples": Real(0, 1), "max_trials": Whole(1, 20)},
    "svr": {"C": Real(0, 10), "epsilon": Real(1.1, 1.9)},
    "extraTrees": {
        "n_estimators": Whole(10, 300, 10),
        "max_depth": Whole(1, 11),
        "min_impurity_decrease": Real(0.0001, 0.5),
        "max_features": Choice(("sqrt", "log2")),
        "bootstrap": YES_NO,
        "min_samples_split": Choice((2, 5, 7, 9, 10)),
        "min_samples_leaf": Whole(2, 6),
    },
}


@dataclass
class Task:
    """Training rows and what to learn from them."""

    train: DataFrame
    features: list[str]
    target: str
    rows: int
    labels: list[Any] | None = None
    seed: int = 5

    def vectors(self) -> DataFrame:
        """Rows as the estimators want them: __features and a numeric __label."""
        y = index_of(col(self.target), self.labels) if self.labels is not None else col(self.target).cast("double")
        rows = self.train.select(*[col(f).cast("double").alias(f) for f in self.features], y.alias("__label")).na.drop()
        return VectorAssembler(inputCols=self.features, outputCol="__features").transform(rows)


def _columns(**more: Any) -> dict[str, Any]:
    return {"featuresCol": "__features", "labelCol": "__label", **more}


def _depth(p: dict[str, Any], fallback: int = 5) -> int:
    return min(int(p.get("max_depth", fallback)), 30)


def _subset(value: Any) -> str:
    return str(float(value)) if isinstance(value, float) else {"sqrt": "sqrt", "log2": "log2"}.get(value, "all")


def _fit_ml(task: Task, estimator: Any) -> MlModel:
    return MlModel(task.features, estimator.fit(task.vectors()), task.labels)


def _tree(task: Task, p: dict[str, Any]) -> MlModel:
    kind = mc.DecisionTreeClassifier if task.labels else mr.DecisionTreeRegressor
    extra = {"impurity": p.get("criterion", "gini")} if task.labels else {}
    return _fit_ml(
        task,
        kind(**_columns(maxDepth=_depth(p), minInstancesPerNode=int(p.get("min_samples_leaf", 1)), minInfoGain=float(p.get("min_impurity_decrease", 0.0)), seed=task.seed, **extra)),
    )


def _forest(task: Task, p: dict[str, Any], trees: int = 100) -> MlModel:
    kind = mc.RandomForestClassifier if task.labels else mr.RandomForestRegressor
    return _fit_ml(
        task,
        kind(
            **_columns(
                numTrees=int(p.get("n_estimators", trees)),
                maxDepth=_depth(p),
                minInfoGain=float(p.get("min_impurity_decrease", 0.0)),
                featureSubsetStrategy=_subset(p.get("max_features", "all")),
                subsamplingRate=float(p.get("max_samples", 1.0)),
                bootstrap=bool(p.get("bootstrap", True)),
                seed=task.seed,
            )
        ),
    )


def _bagging(task: Task, p: dict[str, Any]) -> MlModel:
    return _forest(task, p, trees=10)


def _one_vs_rest(task: Task, estimator: Any) -> Any:
    if task.labels is not None and len(task.labels) > 2:
        return mc.OneVsRest(classifier=estimator, **_columns())
    return estimator


def _boosting(task: Task, p: dict[str, Any]) -> MlModel:
    kind = mc.GBTClassifier if task.labels else mr.GBTRegressor
    estimator = kind(
        **_columns(
            maxIter=int(p.get("n_estimators", 20)),
            stepSize=float(p.get("learning_rate", 0.1)),
            maxDepth=_depth(p, 3),
            subsamplingRate=float(p.get("subsample", 1.0)),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            minInfoGain=float(p.get("min_impurity_decrease", 0.0)),
            featureSubsetStrategy=_subset(p.get("max_features", p.get("colsample_bytree", "all"))),
            seed=task.seed,
        )
    )
    return _fit_ml(task, _one_vs_rest(task, estimator))


def _logistic(task: Task, p: dict[str, Any]) -> MlModel:
    # the penalty weighs the whole sum of losses there, the mean of losses here
    strength = 1.0 / (float(p.get("C", 1.0)) * task.rows)
    return _fit_ml(task, mc.LogisticRegression(**_columns(maxIter=int(p.get("max_iter", 100)), regParam=strength, elasticNetParam=0.0)))


def _ridge_classifier(task: Task, p: dict[str, Any]) -> MlModel:
    return _fit_ml(task, mc.LogisticRegression(**_columns(regParam=float(p.get("alpha", 1.0)) / task.rows, elasticNetParam=0.0)))


def _hinge(task: Task, p: dict[str, Any]) -> MlModel:
    strength = 1.0 / (float(p["C"]) * task.rows) if "C" in p else 0.0001
    estimator = mc.LinearSVC(**_columns(maxIter=int(p.get("max_iter", 100)), tol=float(p.get("tol", 1e-3)), regParam=strength))
    return _fit_ml(task, _one_vs_rest(task, estimator))


def _kernel_classifier(task: Task, p: dict[str, Any]) -> KernelModel:
    estimator = support_classifier(float(p.get("C", 1.0)), task.rows, int(p.get("max_iter", 100)))
    return _kernel(task, p, estimator, p.get("class_weight", "balanced") == "balanced")


def _process_classifier(task: Task, p: dict[str, Any]) -> KernelModel:
    return _kernel(task, p, logistic_process(int(p.get("max_iter_predict", p.get("max_iter", 100)))))


def _kernel_regressor(task: Task, p: dict[str, Any]) -> KernelModel:
    return _kernel(task, p, support_regressor(float(p.get("C", 1.0)), float(p.get("epsilon", 1.35)), task.rows))


def _kernel(task: Task, p: dict[str, Any], estimator: Any, balanced: bool = False) -> KernelModel:
    label = index_of(col(task.target), task.labels) if task.labels is not None else col(task.target)
    whole = task.train.na.drop(subset=task.features)
    return fit_kernel(whole, task.features, label, estimator, task.labels, p.get("gamma"), int(p.get("n_components", SIZE)), task.seed, balanced)


def _naive_bayes(task: Task, p: dict[str, Any]) -> MlModel:
    return _fit_ml(task, mc.NaiveBayes(**_columns(modelType="gaussian")))


def _moments(task: Task) -> dict[Any, tuple[float, np.ndarray, np.ndarray]]:
    """Per class its share, mean and covariance, from two aggregations."""
    sizes = {r[0]: r[1] for r in task.train.groupBy(col(task.target)).agg(F.count(F.lit(1))).collect()}
    whole = sum(sizes[c] for c in task.labels)
    moments = _group_moments(task.train, task.features, task.target, task.labels)
    return {c: (sizes[c] / whole, *moments[c]) for c in task.labels}


def _linear_discriminant(task: Task, p: dict[str, Any]) -> ScoreModel:
    stats = _moments(task)
    pooled = sum(share * cov for share, _, cov in stats.values())
    shrink = p.get("shrinkage", "empirical")
    shrink = 0.0 if shrink == "empirical" else float(shrink)
    size = len(task.features)
    inverse = np.linalg.pinv((1 - shrink) * pooled + shrink * np.trace(pooled) / size * np.eye(size))
    weights = [inverse @ mean for _, mean, _ in stats.values()]
    constants = [float(math.log(share) - mean @ w / 2) for (share, mean, _), w in zip(stats.values(), weights)]
    return ScoreModel(task.features, task.labels, constants, [w.tolist() for w in weights], [])


def _quadratic_discriminant(task: Task, p: dict[str, Any]) -> ScoreModel:
    reg = float(p.get("reg_param", 0.0))
    constants, centres, forms = [], [], []
    for share, mean, cov in _moments(task).values():
        shaped = (1 - reg) * cov + reg * np.eye(len(mean))
        sign, logdet = np.linalg.slogdet(shaped)
        constants.append(float(math.log(share) - (logdet if sign > 0 else 0.0) / 2))
        centres.append(mean.tolist())
        forms.append(np.linalg.pinv(shaped).tolist())
    return ScoreModel(task.features, task.labels, constants, [[0.0] * len(task.features)] * len(constants), centres, forms)


def _neighbours(task: Task, p: dict[str, Any]) -> NeighbourModel:
    return NeighbourModel(
        task.train.select(*[col(f) for f in task.features], col(task.target)),
        task.features,
        task.target,
        int(p.get("n_neighbors", 5)),
        p.get("weights", "uniform") == "distance",
        task.labels is not None,
        layered=p.get("layered"),
    )


def _linear(task: Task, p: dict[str, Any], mix: float, **more: Any) -> LinearModel:
    estimator = mr.LinearRegression(
        **_columns(
            regParam=float(p.get("alpha", 0.0)),
            elasticNetParam=mix,
            fitIntercept=bool(p.get("fit_intercept", True)),
            standardization=bool(p.get("normalize", True)),
            **more,
        )
    )
    model = estimator.fit(task.vectors())
    return LinearModel(task.features, [float(b) for b in model.coefficients], float(model.intercept))


def _ordinary(task: Task, p: dict[str, Any]) -> LinearModel:
    return _linear(task, p, 0.0, solver="normal")


def _lasso(task: Task, p: dict[str, Any]) -> LinearModel:
    return _linear(task, {"alpha": 1.0, **p}, 1.0)


def _ridge(task: Task, p: dict[str, Any]) -> LinearModel:
    # the penalty weighs the sum of squares there, half their mean here
    return _linear(task, {**p, "alpha": float(p.get("alpha", 1.0)) / task.rows}, 0.0)


def _elastic(task: Task, p: dict[str, Any]) -> LinearModel:
    return _linear(task, {"alpha": 1.0, **p}, float(p.get("l1_ratio", 0.5)))


def _huber(task: Task, p: dict[str, Any]) -> LinearModel:
    # as in ridge, the penalty weighs a sum there and a mean here
    return _linear(task, {**p, "alpha": float(p.get("alpha", 0.0001)) / task.rows}, 0.0, loss="huber", epsilon=max(1.0001, float(p.get("epsilon", 1.35))))


def _bayes(task: Task, p: dict[str, Any]) -> LinearModel:
    n, means, cov = covariance(task.train, [*task.features, task.target])
    product = n * cov
    if not p.get("fit_intercept", True):
        product = product + n * np.outer(means, means)
    beta = bayesian_ridge(
        product[:-1, :-1], product[:-1, -1], product[-1, -1], n,
        *[float(p.get(k, 1e-6)) for k in ("alpha_1", "alpha_2", "lambda_1", "lambda_2")],
    )
    intercept = float(means[-1] - means[:-1] @ beta) if p.get("fit_intercept", True) else 0.0
    return LinearModel(task.features, [float(b) for b in beta], intercept)


def _centred(task: Task, p: dict[str, Any]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, mean cross products of features and target around them, or around 0 without an intercept)."""
    n, means, cov = covariance(task.train, [*task.features, task.target])
    return n, means, cov if p.get("fit_intercept", True) else cov + np.outer(means, means)


def _line(task: Task, p: dict[str, Any], means: np.ndarray, beta: np.ndarray) -> LinearModel:
    intercept = float(means[-1] - means[:-1] @ beta) if p.get("fit_intercept", True) else 0.0
    return LinearModel(task.features, [float(b) for b in beta], intercept)


def _relevance(task: Task, p: dict[str, Any]) -> LinearModel:
    n, means, product = _centred(task, p)
    product = n * product
    beta = relevance(
        product[:-1, :-1], product[:-1, -1], product[-1, -1], n, float(p.get("threshold_lambda", 10_000)),
        *[float(p.get(k, 1e-6)) for k in ("alpha_1", "alpha_2", "lambda_1", "lambda_2")],
    )
    return _line(task, p, means, beta)


def _least_angle(task: Task, p: dict[str, Any], lasso: bool) -> LinearModel:
    _, means, product = _centred(task, p)
    alpha = float(p.get("alpha", 1.0)) if lasso else 0.0
    return _line(task, p, means, least_angle(product[:-1, :-1], product[:-1, -1], alpha, lasso, float(p.get("eps", 1e-12))))


def _lars(task: Task, p: dict[str, Any]) -> LinearModel:
    return _least_angle(task, {k: v for k, v in p.items() if k != "alpha"}, False)


def _lasso_lars(task: Task, p: dict[str, Any]) -> LinearModel:
    return _least_angle(task, p, True)


def _ransac(task: Task, p: dict[str, Any]) -> LinearModel:
    """The line of the rows that agree with the best of some lines through drawn rows (Fischler and Bolles 1981).

    Every trial draws its share of rows by key hash; all trials' cross products come from one pass, their agreeing rows from a second.
    """
    names = [*task.features, task.target]
    rows = task.train.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).na.drop()
    width = len(names)
    share = max(float(p.get("min_samples", 0.0)), min(1.0, 4.0 * width / max(task.rows, 1)))
    trials = int(p.get("max_trials", 20))
    ones = [F.lit(1.0), *[F.col(f"v{i}") for i in range(width)]]
    middle = exact_quantiles(rows, {"y": (ones[-1], [0.5])})["y"][0.5]
    near = exact_quantiles(rows, {"d": (F.abs(ones[-1] - F.lit(middle)), [0.5])})["d"][0.5]
    sums = {}
    for t in range(trials):
        drawn = uniform(f"{task.seed}r{t}", *ones[1:]) < share
        sums |= {f"{t}_{i}_{j}": F.sum(F.when(drawn, ones[i] * ones[j])) for i in range(width + 1) for j in range(i, width + 1)}
    found = run_aggregates(rows, sums)

    def solved(get: Callable[[int, int], float | None]) -> np.ndarray:
        m = np.array([[get(min(i, j), max(i, j)) or 0.0 for j in range(width + 1)] for i in range(width + 1)])
        return np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1]

    lines = [solved(lambda i, j, t=t: found[f"{t}_{i}_{j}"]) for t in range(trials)]

    def agrees(line: np.ndarray) -> Column:
        return F.abs(ones[-1] - total([F.lit(float(b)) * x for b, x in zip(line, ones)])) <= F.lit(near)

    counts = run_aggregates(rows, {str(t): F.count_if(agrees(line)) for t, line in enumerate(lines)})
    best = lines[max(range(trials), key=lambda t: (counts[str(t)], -t))]
    last = run_aggregates(
        rows.where(agrees(best)), {f"{i}_{j}": F.sum(ones[i] * ones[j]) for i in range(width + 1) for j in range(i, width + 1)}
    )
    beta = solved(lambda i, j: last[f"{i}_{j}"])
    return LinearModel(task.features, [float(b) for b in beta[1:]], float(beta[0]))


def _adaboost(task: Task, p: dict[str, Any]) -> BoostedModel:
    """SAMME for classes (Hastie et al. 2009), R2 for numbers (Drucker 1997): weighted trees, one after the other."""
    classify = task.labels is not None
    rate, rounds = float(p.get("learning_rate", 1.0)), int(p.get("n_estimators", 50))
    depth = int(p.get("max_depth", 1 if classify else 3))
    maker = mc.DecisionTreeClassifier if classify else mr.DecisionTreeRegressor
    estimator = maker(**_columns(maxDepth=depth, weightCol="__w", seed=task.seed))
    rows = pinned(task.vectors().select("__features", "__label", F.lit(1.0).alias("__w")))
    trees, weights = [], []
    for _ in range(rounds):
        tree = estimator.fit(rows)
        said = tree.transform(rows)
        if classify:
            loss = (F.col("prediction") != F.col("__label")).cast("double")
        else:
            loss = F.abs(F.col("prediction") - F.col("__label"))
            most = said.agg(F.max(loss)).first()[0] or 0.0
            loss = loss / F.lit(most) if most else F.lit(0.0)
            kind = p.get("loss", "linear")
            loss = loss * loss if kind == "square" else 1 - F.exp(-loss) if kind == "exponential" else loss
        error, whole = said.agg(F.sum(F.col("__w") * loss), F.sum("__w")).first()
        error = (error or 0.0) / whole
        if error <= 0:
            trees, weights = [*trees, tree], [*weights, 1.0 if not weights else max(weights)]
            break
        if error >= (1 - 1 / len(task.labels) if classify else 0.5):
            trees, weights = trees or [tree], weights or [1.0]
            break
        if classify:
            weight = rate * (math.log((1 - error) / error) + math.log(max(1, len(task.labels) - 1)))
            change = F.exp(F.lit(weight) * loss)
        else:
            beta = error / (1 - error)
            weight = rate * math.log(1 / beta)
            change = F.pow(F.lit(beta), (1 - loss) * rate)
        trees.append(tree)
        weights.append(weight)
        rows = pinned(said.select("__features", "__label", (F.col("__w") * change * F.lit(task.rows / whole)).alias("__w")))
    return BoostedModel(task.features, trees, weights, task.labels)


def _extra_trees(task: Task, p: dict[str, Any]) -> TreeModel:
    classes = None if task.labels is None else len(task.labels)
    makers = ExtraTrees(
        n_trees=int(p.get("n_estimators", 100)),
        max_depth=_depth(p, 11),
        min_leaf=int(p.get("min_samples_leaf", 1)),
        min_split=int(p.get("min_samples_split", 2)),
        min_decrease=float(p.get("min_impurity_decrease", 0.0)),
        max_features=p.get("max_features", "sqrt" if classes else "all"),
        criterion=p.get("criterion", "gini") if classes else "variance",
        bootstrap=bool(p.get("bootstrap", False)),
        seed=task.seed,
    )
    trees = makers.grow(task.vectors(), task.features, "__label", classes)
    return TreeModel(task.features, trees, [1.0 / len(trees)] * len(trees), task.labels)


Fitter = Callable[[Task, dict[str, Any]], Any]
CLASSIFIERS: dict[str, Fitter] = {
    "DTC": _tree,
    "rf": _forest,
    "bagging": _bagging,
    "gbt": _boosting,
    "LogReg": _logistic,
    "ridge": _ridge_classifier,
    "SGDC": _hinge,
    "svc": _kernel_classifier,
    "gaussian_process": _process_classifier,
    "gnb": _naive_bayes,
    "quadratic_discriminant": _quadratic_discriminant,
    "linear_discriminant": _linear_discriminant,
    "knn": _neighbours,
    "ada": _adaboost,
    "extra_trees": _extra_trees,
}
REGRESSORS: dict[str, Fitter] = {
    "linreg": _ordinary,
    "lassoreg": _lasso,
    "ridgereg": _ridge,
    "elastic": _elastic,
    "gradBoost": _boosting,
    "rf": _forest,
    "dtr": _tree,
    "knn": _neighbours,
    "huber": _huber,
    "bayesian_ridge": _bayes,
    "ard": _relevance,
    "lars": _lars,
    "lassolars": _lasso_lars,
    "adaBoost": _adaboost,
    "ransac": _ransac,
    "svr": _kernel_regressor,
    "extraTrees": _extra_trees,
}


@dataclass(frozen=True)
class Family:
    name: str
    space: dict[str, Any]
    fit: Fitter

    def propose(self, rng: random.Random) -> dict[str, Any]:
        return {k: v.draw(rng) for k, v in self.space.items()}


def classify_candidates() -> dict[str, Family]:
    return {n: Family(n, CLASSIFICATION_SPACES[n], fit) for n, fit in CLASSIFIERS.items()}


def regress_candidates() -> dict[str, Family]:
    return {n: Family(n, REGRESSION_SPACES[n], fit) for n, fit in REGRESSORS.items()}


def make_task(train: DataFrame, target: str, features: Sequence[str], classify: bool, seed: int = 5) -> Task:
    """Count the rows and, for classes, list them."""
    if not classify:
        return Task(train, list(features), target, train.count(), None, seed)
    from ..operators.balance import held_counts

    counts = held_counts(train, target)
    return Task(train, list(features), target, sum(counts.values()), sorted(counts), seed)
