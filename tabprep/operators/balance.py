"""Class sizes, sampling targets, random over- and undersampling."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.choose import mapped, step_value
from ..functions.columns import col, data_type, require
from ..functions.hashing import SPAN, hash32, hash60
from .rank import hash_buckets, hash_rank

MAX_CLASSES = 1_000
REGRESSION_SHARE = 0.05
OVER = ("minority", "not minority", "all", "auto")
UNDER = ("majority", "not minority", "not majority", "all", "auto")
METHODS = {"Random Oversampler": "over", "Random Undersampler": "under", "SMOTE": "over", "Categorical SMOTE": "over"}


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(target, n) per class."""
    require(df, [target])
    return df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))


def class_gap(df: DataFrame, target: str) -> DataFrame:
    """(target, n, gap): rows missing to the largest class."""
    counts = class_counts(df, target)
    most = counts.agg(F.max("n")).first()[0]
    return counts.withColumn("gap", F.lit(most) - F.col("n"))


def problem_type(df: DataFrame, target: str) -> str:
    classes = class_counts(df, target).limit(3).count()
    if classes < 2:
        raise ValueError("only one class: not a classification problem")
    return "binary" if classes == 2 else "multi"


def task_type(df: DataFrame, target: str) -> str:
    """Text is classified; numbers too unless more than 5 % of the rows are distinct values."""
    require(df, [target])
    if isinstance(data_type(df, target), (T.StringType, T.BooleanType)):
        return "classification"
    distinct, rows = class_counts(df, target).agg(F.count(F.lit(1)), F.sum("n")).first()
    return "regression" if distinct > REGRESSION_SHARE * (rows or 0) else "classification"


def held_counts(df: DataFrame, target: str, limit: int = MAX_CLASSES) -> dict[Any, int]:
    """Class sizes on the driver; a target with more classes than `limit` is refused."""
    rows = class_counts(df, target).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{target} has more than {limit} classes")
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: str(r[0]))}


def wanted_rows(counts: dict[Any, int], method: str, strategy: str | float | dict = "auto") -> dict[Any, int]:
    """Rows per class after sampling."""
    if len(counts) < 2:
        raise ValueError("only one class: not a classification problem")
    if method not in METHODS:
        raise ValueError(f"unknown sampling method: {method}")
    over = METHODS[method] == "over"
    large = max(counts, key=lambda c: counts[c])
    small = min(counts, key=lambda c: counts[c])
    wanted = dict(counts)
    if isinstance(strategy, dict):
        if set(strategy) != set(counts):
            raise ValueError("the strategy must name every class once")
        wanted = {c: int(strategy[c]) for c in counts}
    elif isinstance(strategy, float):
        if len(counts) != 2:
            raise ValueError("a ratio needs exactly two classes")
        if not 0 < strategy <= 1:
            raise ValueError("a ratio must lie between 0 and 1")
        if over:
            wanted[small] = int(strategy * counts[large])
        else:
            wanted[large] = int(counts[small] / strategy)
    elif strategy in (OVER if over else UNDER):
        chosen = {
            "minority": [small],
            "majority": [large],
            "not minority": [c for c in counts if c != small],
            "not majority": [c for c in counts if c != large],
            "all": list(counts),
            "auto": [c for c in counts if c != (large if over else small)],
        }[strategy]
        for c in chosen:
            wanted[c] = counts[large] if over else counts[small]
    else:
        raise ValueError(f"strategy {strategy!r} does not suit {method}")
    for c, n in wanted.items():
        if (over and n < counts[c]) or (not over and n > counts[c]):
            raise ValueError(f"class {c}: {n} rows wanted, {counts[c]} there")
    return wanted


def sampling_targets(df: DataFrame, target: str, method: str, strategy: str | float | dict = "auto") -> DataFrame:
    """(target, n, wanted) per class."""
    counts = held_counts(df, target)
    wanted = wanted_rows(counts, method, strategy)
    kind = data_type(df, target).simpleString()
    return df.sparkSession.createDataFrame([(c, counts[c], wanted[c]) for c in counts], f"`{target}` {kind}, n bigint, wanted bigint")


def draws(spark: SparkSession, need: dict[Any, int], target: str, dtype: T.DataType) -> DataFrame:
    """One row per draw: (target, j) with j = 1 … need of the class, made by the tasks."""
    need = {c: n for c, n in need.items() if n > 0}
    rows = spark.range(sum(need.values()))
    starts = list(accumulate(need.values(), initial=0))[:-1]
    label = step_value(F.col("id"), starts[1:], list(need)).cast(dtype)
    start = step_value(F.col("id"), starts[1:], starts)
    return rows.select(label.alias(target), (F.col("id") - start + 1).alias("j"))


def drawn_rows(df: DataFrame, target: str, need: dict[Any, int], counts: dict[Any, int], key: Sequence[str], seed: int) -> DataFrame:
    """The source row of every draw (target, j, other columns), with replacement."""
    live = {c: n for c, n in need.items() if n > 0}
    ranked = hash_rank(df.where(col(target).isin(*live)), [target], key, seed, "__at")
    picks = draws(df.sparkSession, live, target, data_type(df, target))
    picks = picks.withColumn("__at", F.pmod(hash60(seed, col(target), F.col("j")), mapped(col(target), counts)))
    return picks.join(ranked, [target, "__at"]).drop("__at")


def random_oversample(
    df: DataFrame, target: str, strategy: str | float | dict = "auto", key: Sequence[str] = (), seed: int = 5
) -> DataFrame:
    """All rows, and per class copies drawn with replacement up to the wanted number."""
    counts = held_counts(df, target)
    wanted = wanted_rows(counts, "Random Oversampler", strategy)
    need = {c: wanted[c] - counts[c] for c in counts}
    if not any(need.values()):
        return df
    more = drawn_rows(df, target, need, counts, list(key) or [c for c in df.columns if c != target], seed)
    return df.unionByName(more.select(*[col(c) for c in df.columns]))


def random_undersample(
    df: DataFrame, target: str, strategy: str | float | dict = "auto", key: Sequence[str] = (), seed: int = 5
) -> DataFrame:
    """Exactly the wanted rows of each class: those with the smallest key hashes.

    Counts per hash range tell which ranges are kept whole; only the one range per class where the
    count runs out is sorted, so the table itself is filtered and not shuffled.
    """
    counts = held_counts(df, target)
    wanted = wanted_rows(counts, "Random Undersampler", strategy)
    key = list(key) or [c for c in df.columns if c != target]
    width = -(-SPAN // hash_buckets(df))
    tagged = (
        df.where(col(target).isNotNull())
        .withColumn("__h", hash32(seed, *[col(k) for k in key]))
        .withColumn("__b", F.floor(F.col("__h") / F.lit(width)).cast("int"))
    )
    earlier = W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        tagged.groupBy(col(target).alias("__c"), "__b")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__room", mapped(F.col("__c"), wanted) - F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
        .where(F.col("__room") > 0)
    )
    # classes times hash ranges, both bounded, so this table is small
    kept = tagged.join(F.broadcast(sizes.withColumnRenamed("__b", "__bb")), (col(target) == F.col("__c")) & (F.col("__b") == F.col("__bb")))
    whole = kept.where(F.col("__room") >= F.col("__rows"))
    order = W.partitionBy("__c", "__b").orderBy("__h", *[col(k) for k in key])
    edge = kept.where(F.col("__room") < F.col("__rows")).withColumn("__rn", F.row_number().over(order))
    names = [col(c) for c in df.columns]
    return whole.select(*names).unionByName(edge.where(F.col("__rn") <= F.col("__room")).select(*names))
