"""Exact global positions without a one-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import col, require
from ..functions.hashing import SPAN, hash32
from ..session import pinned, shuffle_width

LOW_BITS = (1 << 33) - 1


def global_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    key: Sequence[str],
    name: str = "rank0",
    by: Sequence[str] = (),
) -> DataFrame:
    """0-based position by `order`, ties by `key`, counted from 0 in every group of `by`.

    A range shuffle on the whole (by, order, key) tuple splits a hot value or a hot group by its key.
    The sorted rows are checkpointed once, so the counts and the rows come from the same layout; then a
    row's position is its place in its partition plus the rows of its group in earlier partitions.
    """
    require(df, [*by, *key])
    order_cols = [col(o) if isinstance(o, str) else o for o in order]
    sort = [*[col(b).asc() for b in by], *order_cols, *[col(k).asc() for k in key]]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    placed = pinned(placed)
    part = F.shiftright("__at", 33)
    place = F.col("__at").bitwiseAND(F.lit(LOW_BITS))
    starts = (
        placed.groupBy(*[col(b).alias(f"__by{i}") for i, b in enumerate(by)], part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__rows"), F.min(place).alias("__first"))
    )
    # one row per (group, partition): groups in more than one partition are few per partition
    groups = [f"__by{i}" for i in range(len(by))]
    before = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    match = [col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]
    on = part == F.col("__part")
    for m in match:
        on = on & m
    return (
        placed.join(starts if by else F.broadcast(starts), on, "inner")
        .withColumn(name, place - F.col("__first") + F.col("__before"))
        .drop("__at", "__part", "__first", "__before", *groups)
    )


def position_rank(df: DataFrame, columns: Sequence[str], key: Sequence[str], name: str = "position") -> DataFrame:
    """Sort by `columns` and label every row with its position."""
    return global_rank(df, list(columns), key, name)


def hash_buckets(df: DataFrame) -> int:
    return 4 * shuffle_width(df.sparkSession)


def hash_rank(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, name: str = "rank0") -> DataFrame:
    """0-based rank by key hash within each group of `by`.

    The hash is uniform, so equal hash ranges hold equal shares of any group, however hot the group is.
    """
    require(df, [*by, *key])
    buckets = hash_buckets(df)
    width = -(-SPAN // buckets)
    tagged = df.withColumn("__h", hash32(seed, *[col(k) for k in key])).withColumn(
        "__b", F.floor(F.col("__h") / F.lit(width)).cast("int")
    )
    groups = [f"__by{i}" for i in range(len(by))]
    sizes = tagged.groupBy(*[col(b).alias(g) for b, g in zip(by, groups)], F.col("__b").alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    before = W.partitionBy(*groups).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    within = W.partitionBy(*[col(b) for b in by], F.col("__b")).orderBy("__h", *[col(k) for k in key])
    ranked = tagged.withColumn("__rn", F.row_number().over(within))
    on = F.col("__b") == F.col("__bucket")
    for b, g in zip(by, groups):
        on = on & col(b).eqNullSafe(F.col(g))
    return (
        ranked.join(starts, on, "inner")
        .withColumn(name, F.col("__rn") - 1 + F.col("__before"))
        .drop("__h", "__b", "__rn", "__bucket", "__before", *groups)
    )


def sort_by(df: DataFrame, columns: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    require(df, columns)
    flags = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    return df.orderBy(*[col(c).asc() if up else col(c).desc() for c, up in zip(columns, flags)])


def first_n(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_k(df: DataFrame, column: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest value; each task keeps k, never a full sort."""
    require(df, [column, *ties])
    return df.orderBy(col(column).desc_nulls_last(), *[col(t).asc() for t in ties]).limit(k)
