"""New columns from arithmetic on several columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, ratio, require, require_numeric, total
from ..plans.feature_step import FeatureStep, register_feature_step


def poly_features(df: DataFrame, feature_degree: Sequence[dict[str, Any]]) -> DataFrame:
    """name^2 … name^n for every {"feature", "degree"}."""
    made = {}
    for entry in feature_degree:
        name, degree = entry["feature"], int(entry["degree"])
        require_numeric(df, [name])
        if degree <= 1:
            raise ValueError(f"degree must be above 1: {name}")
        made.update({f"{name}^{i}": F.pow(col(name), F.lit(float(i))) for i in range(2, degree + 1)})
    return df.withColumns(made)


def fe_concat(df: DataFrame, features: Sequence[str], concat_using: str | None) -> DataFrame:
    """Values as text with the separator between; the name puts it before every feature."""
    require(df, features)
    if concat_using is None:
        raise ValueError("concat needs a separator")
    name = "".join(f"{concat_using}{f}" for f in features)
    return df.withColumn(name, F.concat_ws(concat_using, *[col(f).cast("string") for f in features]))


def fe_product(df: DataFrame, features: Sequence[str]) -> DataFrame:
    require_numeric(df, features)
    return df.withColumn("Product:  " + " ".join(features), reduce(lambda a, b: a * b, [col(f) for f in features]))


def fe_addition(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sum of the columns; a gap counts as zero."""
    require_numeric(df, features)
    return df.withColumn("Sum:  " + " ".join(features), total(F.coalesce(col(f), F.lit(0)) for f in features))


def fe_subtraction(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """First column less the others; a gap in the others counts as zero."""
    require_numeric(df, features)
    first, *rest = features
    value = col(first) - total(F.coalesce(col(f), F.lit(0)) for f in rest) if rest else col(first)
    return df.withColumn("sub:  " + " ".join(features), value)


def fe_ratio(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """First column divided by each next one; NULL when a divisor is zero."""
    require_numeric(df, features)
    return df.withColumn("Ratio/" + "/".join(features), reduce(ratio, [col(f) for f in features]))


OPERATIONS = {
    "addition": fe_addition,
    "subtraction": fe_subtraction,
    "multiplication": fe_product,
    "ratio": fe_ratio,
}


def fe_math_batch(df: DataFrame, features_operation: Sequence[dict[str, Any]]) -> DataFrame:
    """Several operations in order; later ones may use earlier results."""
    for entry in features_operation:
        kind = entry["operationType"].lower()
        if kind == "concat":
            df = fe_concat(df, entry["feature"], entry.get("concat_using"))
        elif kind in OPERATIONS:
            df = OPERATIONS[kind](df, entry["feature"])
        else:
            raise ValueError(f"unknown operation: {kind}")
    return df


def fe_interaction(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Product of every pair of columns as a_b."""
    require_numeric(df, features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    return df.withColumns({f"{a}_{b}": col(a) * col(b) for a, b in pairs})


def fe_cluster(df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 5, name: str = "cluster") -> DataFrame:
    """Cluster number of every row by k-means over scaled columns; a gap counts as the mean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from ..functions.gram import covariance

    n, means, cov = covariance(df, features)
    scaled = {
        f"__s{i}": (F.coalesce(col(f).cast("double"), F.lit(float(m))) - F.lit(float(m))) / F.lit(float(v**0.5) or 1.0)
        for i, (f, m, v) in enumerate(zip(features, means, cov.diagonal()))
    }
    rows = df.withColumns(scaled)
    rows = VectorAssembler(inputCols=list(scaled), outputCol="__features").transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol=name).fit(rows)
    return model.transform(rows).drop("__features", *scaled)


def fe_power(df: DataFrame, features: Sequence[str], **options: Any) -> DataFrame:
    """Box–Cox of every column, all lambdas fitted in shared passes."""
    from .mathops import MathOp
    from ..plans.pipeline import Pipeline

    require_numeric(df, features)
    model = Pipeline([MathOp(f, "boxcox", **options) for f in features]).fit(df)
    return model.transform(df).select(*[col(c) for c in df.columns])


@register_feature_step
class PolynomialStep(FeatureStep):
    kind = "polynomial_Features"

    def __init__(self, feature_degree: list[dict[str, Any]]) -> None:
        super().__init__(feature_degree=feature_degree)

    def transform(self, df: DataFrame) -> DataFrame:
        return poly_features(df, self.params["feature_degree"])


@register_feature_step
class MathStep(FeatureStep):
    kind = "math_Ops"

    def __init__(self, features_Operation: list[dict[str, Any]]) -> None:
        super().__init__(features_Operation=features_Operation)

    def transform(self, df: DataFrame) -> DataFrame:
        return fe_math_batch(df, self.params["features_Operation"])
