"""Category levels: near-constant columns, rare, unseen and too many levels, and whole-table defaults."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import col, data_type, is_numeric, numeric_columns, require, require_numeric
from ..functions.levels import level_counts, lookup, value_counts
from ..plans.pipeline import Pipeline
from .bins import Bin
from .impute import Impute

RARE_LABEL = "others_infrequent"


def variance_flags(
    df: DataFrame, columns: Sequence[str] | None = None, freq_ratio: float = 20.0, unique_pct: float = 10.0
) -> DataFrame:
    """(column, distinct_values, top_n, second_n, near_zero) of every column.

    Near zero: one distinct value, or the commonest value is more than `freq_ratio` times as frequent
    as the second and the distinct values are under `unique_pct` percent of the rows.
    """
    names = list(columns or df.columns)
    require(df, names)
    parts = []
    for counts in value_counts(df, {n: col(n) for n in names}).values():
        by_size = W.partitionBy("column").orderBy(F.desc("n"))
        best = counts.withColumn("place", F.row_number().over(by_size)).where("place <= 2")
        top = best.groupBy("column").agg(
            F.max("n").alias("top_n"), F.max(F.when(F.col("place") == 2, F.col("n"))).alias("second_n")
        )
        sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("rows"))
        parts.append(sizes.join(top, "column"))
    flags = parts[0]
    for p in parts[1:]:
        flags = flags.unionByName(p)
    near = F.col("second_n").isNull() | (
        (F.col("top_n") > F.lit(float(freq_ratio)) * F.col("second_n"))
        & (F.col("distinct_values") * 100.0 < F.lit(float(unique_pct)) * F.col("rows"))
    )
    return flags.select("column", "distinct_values", "top_n", "second_n", near.alias("near_zero"))


def near_zero_variance(df: DataFrame, freq_ratio: float = 20.0, unique_pct: float = 10.0, keep: Sequence[str] = ()) -> DataFrame:
    """Drop near-constant columns; `keep` names columns that always stay."""
    tested = [c for c in df.columns if c not in keep]
    flags = variance_flags(df, tested, freq_ratio, unique_pct)
    known = {r["column"]: r["near_zero"] for r in flags.collect()}
    return df.drop(*[c for c in tested if known.get(c, True)])


def club_rare_levels(df: DataFrame, column: str, threshold: float = 0.05, label: str = RARE_LABEL) -> DataFrame:
    """Levels below `threshold` of the rows become one level. Frequent levels are at most 1/threshold."""
    require(df, [column])
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    counts = level_counts(df, column)
    rows = df.agg(F.count(col(column))).first()[0]
    frequent = [r["value"] for r in counts.where(F.col("n") >= threshold * rows).select("value").collect()]
    kept = F.when(col(column).isNull() | col(column).isin(frequent), col(column)).otherwise(F.lit(label))
    return df.withColumn(column, kept)


def trained_levels(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the levels a model was trained on."""
    return level_counts(df, column)


def untrained_levels(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Levels not seen in training become the least frequent training level (the smallest on a tie)."""
    require(df, [column])
    fill = levels.agg(F.min_by("value", F.struct("n", "value"))).first()[0]
    known = lookup(df, col(column), levels.withColumn("__known", F.lit(True)), "__known")
    value = F.when(col(column).isNull() | F.col("__known"), col(column)).otherwise(F.lit(fill))
    return known.withColumn(column, value).select(*[col(c) for c in df.columns])


def level_clusters(df: DataFrame, column: str, k: int, measures: Sequence[str], seed: int = 5) -> DataFrame:
    """(value, n, cluster): levels grouped by k-means over their count and the mean of each measure."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    require(df, [column])
    require_numeric(df, measures)
    stats = (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.avg(col(m)), F.lit(0.0)).alias(f"m{i}") for i, m in enumerate(measures)])
    )
    raw = VectorAssembler(inputCols=["n", *[f"m{i}" for i in range(len(measures))]], outputCol="raw").transform(stats)
    scaled = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(raw).transform(raw)
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(scaled)
    return model.transform(scaled).select("value", "n", "cluster")


def cardinality_reduction(df: DataFrame, column: str, k: int, measures: Sequence[str] | None = None, seed: int = 5) -> DataFrame:
    """Replace each level by the number of its cluster."""
    measures = [m for m in (measures or numeric_columns(df)) if m != column]
    levels = level_clusters(df, column, k, measures, seed)
    joined = lookup(df, col(column), levels, "cluster")
    return joined.withColumn(column, F.col("cluster")).select(*[col(c) for c in df.columns])


def auto_binning(df: DataFrame, options: dict[str, Any] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """Uniform bins for every numeric column; options: bins (5)."""
    bins = (options or {}).get("bins", 5)
    names = [c for c in numeric_columns(df) if c not in skip]
    return Pipeline([Bin(c, "kbins", bins) for c in names]).fit(df).transform(df).select(*[col(c) for c in df.columns])


def auto_impute(
    df: DataFrame, num_strategy: str = "mean", cat_strategy: str = "most_frequent", skip: Sequence[str] = ()
) -> DataFrame:
    """Fill every column: numbers by one strategy, strings by the other, all fits in shared passes."""
    steps = []
    for c in df.columns:
        dtype = data_type(df, c)
        if c in skip:
            continue
        if is_numeric(dtype):
            steps.append(Impute(c, num_strategy))
        elif dtype.typeName() == "string":
            steps.append(Impute(c, cat_strategy))
    return Pipeline(steps).fit(df).transform(df).select(*[col(c) for c in df.columns])
