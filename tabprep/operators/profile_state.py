"""A profile that can be kept beside a version and merged: the profile of appended versions without reading their rows again.

The state has one row per column: counts, moments and range are exact; ranks come from a KLL sketch, distinct values from a
HyperLogLog sketch and frequent values from a frequent-items sketch, all native aggregates whose parts merge in the tasks.
The exact measures of `profile` stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, data_type, is_numeric, require

RANK_K = 2_000  # KLL: ranks are off by less than 0.3 % of the rows
DISTINCT_LG = 14  # HyperLogLog: a standard error of 0.8 %
TRACKED = 10_000  # frequent items: exact up to so many different values, else off by about 3.5/TRACKED of the rows
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def profile_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, numeric, rows, present, mean, m2, least, most, zeros, ranks, distinct, frequent), a row per column, in one pass.

    NaN counts as missing. Columns that are not numeric are measured by their text. An empty table has no row.
    """
    names = list(columns or df.columns)
    require(df, names)

    def cell(name: str) -> Column:
        number = is_numeric(data_type(df, name))
        none = F.lit(None)
        x = F.nanvl(col(name).cast("double"), none.cast("double")) + F.lit(0.0) if number else none.cast("double")
        text = F.when(x.isNotNull(), col(name).cast("string")) if number else col(name).cast("string")
        return F.struct(F.lit(name).alias("column"), F.lit(number).alias("numeric"), x.alias("x"), text.alias("text"))

    x = F.col("x")
    return (
        df.select(F.inline(F.array(*[cell(n) for n in names])))
        .groupBy("column", "numeric")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("text").alias("present"),
            F.avg(x).alias("mean"),
            (F.var_pop(x) * F.count(x)).alias("m2"),
            F.min(x).alias("least"),
            F.max(x).alias("most"),
            F.count_if(x == 0).alias("zeros"),
            F.kll_sketch_agg_double(x, RANK_K).alias("ranks"),
            F.hll_sketch_agg("text", DISTINCT_LG).alias("distinct"),
            F.expr(f"approx_top_k_accumulate(text, {TRACKED})").alias("frequent"),
        )
    )


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows together, from states of any parts; a column that some parts lack keeps what the others say."""
    if not states:
        raise ValueError("no states to merge")
    n = F.col("present")
    pooled = F.sum(n * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), n))
    parts = reduce(DataFrame.unionByName, states)
    means = parts.groupBy("column", "numeric").agg(pooled.alias("pooled"))  # few rows: columns times parts
    both = parts.join(means, ["column", "numeric"])
    return both.groupBy("column", "numeric").agg(
        F.sum("rows").alias("rows"),
        F.sum("present").alias("present"),
        F.max("pooled").alias("mean"),
        # spread within the parts and between their means
        F.sum(F.col("m2") + n * (F.col("mean") - F.col("pooled")) ** 2).alias("m2"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.sum("zeros").alias("zeros"),
        F.kll_merge_agg_double("ranks", RANK_K).alias("ranks"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"),
    )


def save_state(state: DataFrame, version: str) -> str:
    """Keeps a state beside the version in that folder; writing it twice is an error."""
    path = version.rstrip("/") + "_profile"
    state.write.mode("errorifexists").parquet(path)
    return path


def profile_of(state: DataFrame, k: int = 10) -> DataFrame:
    """(column, rows, missing, mean, std, min, max, zeros, p5 … p95, distinct, frequent): what a state knows.

    `frequent` lists the k commonest values as text with their counts, gaps aside. Quantiles and the numeric measures are NULL
    for other columns.
    """
    n = F.col("present")
    # a quantile of an empty sketch is an error, so it is asked only where there are values
    quantiles = [
        F.when(F.col("numeric") & (n > 0), F.kll_sketch_get_quantile_double("ranks", F.lit(p))).alias(f"p{round(p * 100)}") for p in SHARES
    ]
    listed = F.filter(F.expr(f"approx_top_k_estimate(frequent, {k + 1})"), lambda t: t["item"].isNotNull())
    return state.select(
        "column", "rows", (F.col("rows") - n).alias("missing"), "mean",
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"),
        F.col("least").alias("min"), F.col("most").alias("max"),
        F.when(F.col("numeric"), F.col("zeros")).alias("zeros"), *quantiles,
        F.hll_sketch_estimate("distinct").alias("distinct"), F.slice(listed, 1, k).alias("frequent"),
    )
