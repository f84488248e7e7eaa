"""Scores of predictions: errors, class metrics, fairness between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, data_type, ratio, require

EPS = 2.220446049250313e-16

# metric → whether a larger value is better
DIRECTIONS = {
    "MSE": False, "RMSE": False, "MAE": False, "R2": True, "MSLE": False, "MAPE": False,
    "accuracy": True, "precision": True, "recall": True, "f1": True,
    "parity_diff": False, "disparate_impact": True, "eq_odds_ratio": True, "equal_opportunity": False,
    "parity_ratio": True, "eq_odds_diff": False,
}
# fixed values: short codes of the fairness metrics
CODES = {"DI": "disparate_impact", "DPD": "parity_diff", "EOR": "eq_odds_ratio", "EOD": "equal_opportunity"}
REGRESSION = ("MSE", "RMSE", "MAE", "R2", "MSLE", "MAPE")
CLASSIFICATION = ("accuracy", "precision", "recall", "f1")
FAIRNESS = ("parity_diff", "disparate_impact", "eq_odds_ratio", "equal_opportunity")


def _group(by: str | Sequence[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def regression_metrics(df: DataFrame, y: str, yhat: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """MSE, RMSE, MAE, R2, MSLE, MAPE in one aggregation; any negative value makes MSLE NULL."""
    groups = _group(by)
    require(df, [y, yhat, *groups])
    a, p = col(y).cast("double"), col(yhat).cast("double")
    rows = df.select(*[col(g) for g in groups], a.alias("__a"), p.alias("__p")).na.drop(subset=["__a", "__p"])
    a, p = F.col("__a"), F.col("__p")
    err = a - p
    logs = F.when((a >= 0) & (p >= 0), F.log1p(a) - F.log1p(p))
    found = rows.groupBy(*[col(g) for g in groups]).agg(
        F.avg(err * err).alias("MSE"),
        F.avg(F.abs(err)).alias("MAE"),
        F.var_pop(a).alias("__var"),
        F.avg(logs * logs).alias("__msle"),
        F.count_if((a < 0) | (p < 0)).alias("__neg"),
        F.avg(F.abs(err) / F.greatest(F.abs(a), F.lit(EPS))).alias("MAPE"),
    )
    flat = F.when(F.col("MSE") == 0, 1.0).otherwise(0.0)
    return found.select(
        *[col(g) for g in groups],
        "MSE",
        F.sqrt("MSE").alias("RMSE"),
        "MAE",
        F.when(F.col("__var") == 0, flat).otherwise(1 - ratio(F.col("MSE"), F.col("__var"))).alias("R2"),
        F.when(F.col("__neg") == 0, F.col("__msle")).alias("MSLE"),
        "MAPE",
    )


def label_type(df: DataFrame, *columns: str) -> str:
    """The type in which labels of several columns can be compared: a whole 1 is a 1.0."""
    types = [data_type(df, c) for c in columns]
    if all(isinstance(t, T.IntegralType) for t in types):
        return "bigint"
    if all(isinstance(t, T.NumericType) for t in types):
        return "double"
    return "string"


def classification_metrics(df: DataFrame, y: str, yhat: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 from the confusion counts."""
    groups = _group(by)
    require(df, [y, yhat, *groups])
    g = [col(x) for x in groups]
    kind = label_type(df, y, yhat)
    cells = df.groupBy(*g, col(y).cast(kind).alias("__y"), col(yhat).cast(kind).alias("__p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("__y").alias("c"), F.col("n").alias("real"), zero.alias("said"), F.when(F.col("__y") == F.col("__p"), F.col("n")).otherwise(zero).alias("hit")),
        F.struct(F.col("__p").alias("c"), zero.alias("real"), F.col("n").alias("said"), zero.alias("hit")),
    )
    classes = (
        cells.select(*g, F.inline(sides))
        .groupBy(*g, "c")
        .agg(F.sum("real").alias("real"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
        .withColumn("prec", F.coalesce(ratio(F.col("hit"), F.col("said")), F.lit(0.0)))
        .withColumn("rec", F.coalesce(ratio(F.col("hit"), F.col("real")), F.lit(0.0)))
        .withColumn("f", F.coalesce(ratio(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), F.lit(0.0)))
    )

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * F.col("real")), F.sum("real"))

    return classes.groupBy(*g).agg(
        ratio(F.sum("hit"), F.sum("real")).alias("accuracy"),
        weighted("prec").alias("precision"),
        weighted("rec").alias("recall"),
        weighted("f").alias("f1"),
    )


def group_rates(df: DataFrame, yhat: str, s: str, y: str | None = None) -> DataFrame:
    """Per sensitive group: rows, selection rate, and with `y` the true and false positive rates."""
    require(df, [yhat, s, *([y] if y else [])])
    said = (col(yhat) == 1).cast("double")
    rates = [F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(said, F.lit(0.0))).alias("selection_rate")]
    if y:
        rates += [
            F.coalesce(F.avg(F.when(col(y) == 1, said)), F.lit(0.0)).alias("tpr"),
            F.coalesce(F.avg(F.when(col(y) == 0, said)), F.lit(0.0)).alias("fpr"),
        ]
    return df.groupBy(col(s)).agg(*rates)


def selection_rate(df: DataFrame, yhat: str, s: str) -> DataFrame:
    return group_rates(df, yhat, s)


def _spread(name: str) -> Column:
    return F.max(name) - F.min(name)


def _share(name: str) -> Column:
    return F.coalesce(ratio(F.min(name), F.max(name)), F.lit(0.0))


def disparate_impact(df: DataFrame, yhat: str, s: str) -> DataFrame:
    """Smallest selection rate over the largest; 0 when nothing is selected."""
    return group_rates(df, yhat, s).agg(_share("selection_rate").alias("disparate_impact"))


def parity_difference(df: DataFrame, yhat: str, s: str) -> DataFrame:
    return group_rates(df, yhat, s).agg(_spread("selection_rate").alias("parity_diff"))


def parity_ratio(df: DataFrame, yhat: str, s: str) -> DataFrame:
    return group_rates(df, yhat, s).agg(_share("selection_rate").alias("parity_ratio"))


def eq_odds_difference(df: DataFrame, y: str, yhat: str, s: str) -> DataFrame:
    """The larger of the true-positive and false-positive rate ranges."""
    return group_rates(df, yhat, s, y).agg(F.greatest(_spread("tpr"), _spread("fpr")).alias("eq_odds_diff"))


def eq_odds_ratio(df: DataFrame, y: str, yhat: str, s: str) -> DataFrame:
    """The smaller of the two min/max rate ratios."""
    return group_rates(df, yhat, s, y).agg(F.least(_share("tpr"), _share("fpr")).alias("eq_odds_ratio"))


def equal_opportunity(df: DataFrame, y: str, yhat: str, s: str) -> DataFrame:
    return group_rates(df, yhat, s, y).agg(_spread("tpr").alias("equal_opportunity"))


def fairness_metrics(df: DataFrame, y: str, yhat: str, s: str) -> DataFrame:
    """All leaderboard fairness metrics in one aggregation over the groups."""
    return group_rates(df, yhat, s, y).agg(
        _spread("selection_rate").alias("parity_diff"),
        _share("selection_rate").alias("disparate_impact"),
        F.least(_share("tpr"), _share("fpr")).alias("eq_odds_ratio"),
        _spread("tpr").alias("equal_opportunity"),
    )


def leaderboard(trials: DataFrame, tuning_metric: str) -> DataFrame:
    """Trials best first, the metric as second column; ties by run id."""
    require(trials, [tuning_metric])
    metric = CODES.get(tuning_metric, tuning_metric)
    rest = [c for c in trials.columns if c != metric]
    better = col(metric).desc_nulls_last() if DIRECTIONS[metric] else col(metric).asc_nulls_last()
    ties = [col("run_id")] if "run_id" in rest else []
    return trials.orderBy(better, *ties).select(*[col(c) for c in [rest[0], metric, *rest[1:]]])
