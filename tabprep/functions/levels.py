"""Value counts per column and joins to level tables that survive a hot value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import col, data_type

HOT_SHARE = 0.001


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    if isinstance(dtype, T.NumericType):
        return "double"
    return "string"


def value_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, DataFrame]:
    """Per type family a table (column, value, n): one shuffle counts every column of the family.

    Map-side partial counts collapse hot values before the shuffle. NULLs are left out.
    """
    probe = df.select(*[v.alias(k) for k, v in values.items()])
    families: dict[str, list[str]] = {}
    for name in values:
        families.setdefault(_family(data_type(probe, name)), []).append(name)
    out = {}
    for family, names in families.items():
        pairs = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast(family).alias("value")) for n in names])
        out[family] = (
            probe.select(F.inline(pairs))
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
    return out


def most_frequent(counts: DataFrame) -> DataFrame:
    """(column, value, n) of the most frequent value; the smallest value wins a tie."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), F.max("n").alias("n")
    )


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of one column, its own type kept."""
    return (
        df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )


def lookup(df: DataFrame, key: Column, levels: DataFrame, output: str) -> DataFrame:
    """Left join of `df` to a level table (value, <output>) on key = value, both in their own type.

    The level table has each value once, so a hot value only makes a large partition of `df`, which adaptive execution
    splits; -0.0 meets 0.0 and a null key meets nothing.
    """
    found = levels.select(F.col("value").alias("__value"), F.col(output).alias("__found"))
    joined = df.join(found, key == F.col("__value"), "left")
    return joined.withColumn(output, F.col("__found")).drop("__value", "__found")
