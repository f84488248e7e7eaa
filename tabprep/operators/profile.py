"""Profile of a table: overview, numeric and text columns, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.columns import col, hashable, is_numeric, numeric_columns, ratio, require, require_numeric
from ..functions.hashing import digest
from ..functions.gram import gram_matrix
from ..functions.levels import value_counts
from ..functions.quantiles import exact_quantiles
from ..session import pinned
from .rank import global_rank

MAD_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


SLICE = 40  # columns whose measures share one aggregation; more would outgrow generated code


def _sliced(names: Sequence[str], part) -> DataFrame:
    """Rows of part(slice of names) for all names."""
    out = None
    for i in range(0, len(names), SLICE):
        rows = part(names[i : i + SLICE])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no columns to profile")
    return out


def _stack(wide: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide aggregate row with fields f{i}_{field} to one row per column."""
    rows = F.array(
        *[F.struct(F.lit(n).alias("column"), *[F.col(f"c{i}_{f}").alias(f) for f in fields]) for i, n in enumerate(names)]
    )
    return wide.select(F.inline(rows))


def profile_overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and share, duplicate rows, columns per kind."""
    kinds = {"numeric": 0, "text": 0, "boolean": 0, "date": 0, "other": 0}
    for f in df.schema.fields:
        t = f.dataType
        kinds[
            "numeric" if is_numeric(t)
            else "text" if isinstance(t, T.StringType)
            else "boolean" if isinstance(t, T.BooleanType)
            else "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
            else "other"
        ] += 1
    missing = F.lit(0).cast("bigint")
    for c in df.columns:
        missing = missing + col(c).isNull().cast("bigint")
    # equal rows meet by their digest, counted map-side, so no row is shuffled; groups give rows, gaps and duplicates at once
    groups = df.groupBy(*digest(*[hashable(df, c) for c in df.columns])).agg(F.count(F.lit(1)).alias("__n"), F.sum(missing).alias("__gaps"))
    cells = F.lit(float(len(df.columns)))
    return groups.agg(
        F.sum("__n").alias("rows"),
        F.sum("__gaps").alias("missing_cells"),
        F.sum(F.col("__n") - 1).alias("duplicate_rows"),
    ).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "missing_cells",
        ratio(F.col("missing_cells"), F.col("rows") * cells).alias("missing_share"),
        "duplicate_rows",
        *[F.lit(n).alias(f"{k}_columns") for k, n in kinds.items()],
    )


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts, moments and range of numeric columns: one pass for the measures, one shuffle for distinct values."""
    names = list(columns or numeric_columns(df))
    require_numeric(df, names)
    fields = "count missing mean std variance min max range sum cv zeros negatives infinite".split()

    def measures(i: int, n: str) -> list:
        x = col(n).cast("double")
        found = [
            F.count(x), F.count_if(x.isNull()), F.avg(x), F.stddev_samp(x), F.var_samp(x), F.min(x), F.max(x), F.max(x) - F.min(x),
            F.sum(x), ratio(F.stddev_samp(x), F.avg(x)), F.count_if(x == 0), F.count_if(x < 0), F.count_if(F.abs(x) == F.lit(float("inf"))),
        ]
        return [a.alias(f"c{i}_{k}") for k, a in zip(fields, found)]

    stacked = _sliced(
        names, lambda part: _stack(df.agg(*[a for i, n in enumerate(part) for a in measures(i, n)]), part, fields)
    )
    parts = [
        c.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("n") == 1).alias("unique"))
        for c in value_counts(df, {n: col(n) for n in names}).values()
    ]
    levels = parts[0]
    for p in parts[1:]:
        levels = levels.unionByName(p)
    return stacked.join(F.broadcast(levels), "column", "left").na.fill(0, ["distinct", "unique"])


def profile_quantiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact p5, p25, p50, p75, p95, IQR and the median absolute deviation."""
    names = list(columns or numeric_columns(df))
    require_numeric(df, names)
    first = exact_quantiles(df, {f"c{i}": (col(n), list(MAD_SHARES)) for i, n in enumerate(names)})
    middles = {f"c{i}": first[f"c{i}"][0.5] for i in range(len(names))}
    away = {
        f"c{i}": (F.abs(col(n).cast("double") - F.lit(middles[f"c{i}"])), [0.5])
        for i, n in enumerate(names)
        if middles[f"c{i}"] is not None
    }
    second = exact_quantiles(df, away) if away else {}
    rows = []
    for i, n in enumerate(names):
        q = [first[f"c{i}"][p] for p in MAD_SHARES]
        iqr = None if q[1] is None else q[3] - q[1]
        rows.append((n, *q, iqr, second.get(f"c{i}", {}).get(0.5)))
    fields = "column string, p5 double, p25 double, p50 double, p75 double, p95 double, iqr double, mad double"
    return df.sparkSession.createDataFrame(rows, fields)


def profile_shape(df: DataFrame, columns: Sequence[str] | None = None, key: Sequence[str] = ()) -> DataFrame:
    """Bias-corrected skewness and kurtosis; with `key`, whether values never fall or never rise in key order."""
    names = list(columns or numeric_columns(df))
    require_numeric(df, names)
    measures = []
    for i, c in enumerate(names):
        x = col(c).cast("double")
        n = F.count(x).cast("double")
        g1, g2 = F.skewness(x), F.kurtosis(x)
        skew = F.when(n > 2, ratio(g1 * F.sqrt(n * (n - 1)), n - 2))
        kurt = F.when(n > 3, ratio((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))
        measures += [skew.alias(f"c{i}_skewness"), kurt.alias(f"c{i}_kurtosis")]
    shape = _stack(df.agg(*measures), names, ["skewness", "kurtosis"])
    if not key:
        return shape
    # neighbours in key order meet by their position, so no partition sees the whole order
    placed = global_rank(df.select(*dict.fromkeys([*names, *key])), [], key, "__pos")
    this = placed.select("__pos", *[col(n).alias(f"a{i}") for i, n in enumerate(names)])
    prior = placed.select((F.col("__pos") + 1).alias("__pos"), *[col(n).alias(f"b{i}") for i, n in enumerate(names)])
    steps = this.join(prior, "__pos")
    moves = []
    for i in range(len(names)):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        moves += [
            F.coalesce(F.min(a >= b), F.lit(True)).alias(f"c{i}_never_falls"),
            F.coalesce(F.min(a <= b), F.lit(True)).alias(f"c{i}_never_rises"),
        ]
    return shape.join(F.broadcast(_stack(steps.agg(*moves), names, ["never_falls", "never_rises"])), "column")


def profile_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n) of evenly spaced bins, empty ones included; the last bin holds its upper edge."""
    require_numeric(df, [column])
    x = col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        raise ValueError(f"no values in {column}")
    width = (high - low) / bins
    slot = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int") if width else F.lit(0)
    counts = df.where(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def profile_topk(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """(column, value, n, place) of the commonest values as text; ties by value."""
    require(df, columns)
    counts = value_counts(df, {n: col(n).cast("string") for n in columns})["string"]
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def profile_extremes(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(side, value, n) of the k smallest and k largest distinct values."""
    require(df, [column])
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    low = counts.orderBy(F.asc("value")).limit(k).select(F.lit("smallest").alias("side"), "value", "n")
    high = counts.orderBy(F.desc("value")).limit(k).select(F.lit("largest").alias("side"), "value", "n")
    return low.unionByName(high)


BLANKS = (" ", "\t", "\n", "\r")


def _texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, text) of every text that is there."""
    require(df, columns)
    texts = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("text")) for c in columns])
    return df.select(F.inline(texts)).where(F.col("text").isNotNull())


def _tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, token, n): pieces between blanks as written. Repeated pieces collapse before the shuffle."""
    return (
        _texts(df, columns)
        .select("column", F.explode(F.split("text", f"[{''.join(BLANKS)}]")).alias("token"))
        .where(F.col("token") != "")
        .groupBy("column", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def words(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, word, n): lower-case words between blanks."""
    return _words(_tokens(df, columns))


def _words(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("column", F.lower("token").alias("word")).agg(F.sum("n").alias("n"))


def characters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, character, n)."""
    return _characters(df, columns, _tokens(df, columns))


def _characters(df: DataFrame, columns: Sequence[str], tokens: DataFrame) -> DataFrame:
    """Characters of the distinct pieces, weighted by how often each occurs; blanks by length difference."""
    inner = (
        tokens.select("column", F.explode(F.split("token", "")).alias("character"), "n")
        .where(F.col("character") != "")
        .groupBy("column", "character")
        .agg(F.sum("n").alias("n"))
    )
    size = F.length("text")
    lost = [F.sum((size - F.length(F.replace(F.col("text"), F.lit(b)))).cast("bigint")) for b in BLANKS]
    blanks = F.array(*[F.struct(F.lit(b).alias("character"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BLANKS)])
    outer = (
        _texts(df, columns)
        .groupBy("column")
        .agg(*[x.alias(f"b{i}") for i, x in enumerate(lost)])
        .select("column", F.inline(blanks))
        .where(F.col("n") > 0)
    )
    return inner.unionByName(outer)


def profile_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Length min, mean, median, max, and numbers of characters and words, all and distinct."""
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    require(df, names)
    sizes = [
        a.alias(f"c{i}_{k}")
        for i, n in enumerate(names)
        for k, a in {"min_length": F.min(F.length(col(n))), "mean_length": F.avg(F.length(col(n))), "max_length": F.max(F.length(col(n)))}.items()
    ]
    stacked = _stack(df.agg(*sizes), names, ["min_length", "mean_length", "max_length"])
    medians = exact_quantiles(df, {f"c{i}": (F.length(col(n)), [0.5]) for i, n in enumerate(names)})
    middle = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, medians[f"c{i}"][0.5])])
    tokens = pinned(_tokens(df, names))
    both = [
        t.groupBy("column").agg(F.sum("n").alias(k), F.count(F.lit(1)).alias(f"distinct_{k}"))
        for t, k in ((_characters(df, names, tokens), "characters"), (_words(tokens), "words"))
    ]
    out = stacked.withColumn("median_length", middle[F.col("column")])
    for b in both:
        out = out.join(F.broadcast(b), "column", "left")
    return out.na.fill(0, ["characters", "distinct_characters", "words", "distinct_words"])


def profile_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, present, missing, missing_share): the bar of gaps."""
    names = list(columns or df.columns)
    require(df, names)

    def bar(part: Sequence[str]) -> DataFrame:
        wide = df.agg(
            *[F.count(col(n)).alias(f"c{i}_present") for i, n in enumerate(part)],
            *[F.count_if(col(n).isNull()).alias(f"c{i}_missing") for i, n in enumerate(part)],
        )
        return _stack(wide, part, ["present", "missing"])

    bars = _sliced(names, bar)
    return bars.withColumn("missing_share", ratio(F.col("missing"), F.col("present") + F.col("missing")))


def missing_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, corr, distance) of the gap indicators of every pair: heatmap and dendrogram data.

    Everything follows from the counts of joint gaps, one cross product of the indicators.
    """
    names = list(columns or df.columns)
    require(df, names)
    gaps = df.select(*[col(n).isNull().cast("int").alias(f"g{i}") for i, n in enumerate(names)], F.lit(1).alias("all"))
    joint = gram_matrix(gaps, gaps.columns)
    n, rows = joint[-1, -1], []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            own, other, both = joint[i, i], joint[j, j], joint[i, j]
            spread = own * (n - own) * other * (n - other)
            corr = (n * both - own * other) / spread**0.5 if spread > 0 else None
            rows.append((a, names[j], None if corr is None else float(corr), float((own + other - 2 * both) ** 0.5)))
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double, distance double")
