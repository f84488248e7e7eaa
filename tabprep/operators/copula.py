"""Generated rows from a Gaussian copula: every column keeps its own distribution, and columns move together as in the table.

Fit: the distinct values of each column get their exact mean ranks, a value's normal score is the normal quantile of its rank,
and the scores' correlations are one cross product. Numbers are remembered as KNOTS + 1 order statistics, other columns as
the ranks each level covers, in a table.
Draw: correlated normals made from hashes become shares; a share is read off the knots, or finds the level that covers it.

The driver holds, per class, a square of the columns and the knots of the numeric ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import col, data_type, is_numeric, require
from ..functions.gram import EXPRESSION_COLUMNS, cross_products
from ..functions.hashing import gauss
from ..functions.normal import normal_score, normal_share
from ..session import pinned
from .balance import draws, held_counts
from .correlate import average_ranks, melted_parts, with_ranks

KNOTS = 1_000  # a generated number's distribution is within 1/KNOTS of the table's
ONE = ""  # the class of a table without classes


@dataclass
class Copula:
    """Fitted parts. `factors[class]` times independent normals is correlated; `levels` has a row per level and block of ranks."""

    names: list[str]
    numeric: list[bool]
    rows: dict[str, int]
    correlations: dict[str, np.ndarray]
    factors: dict[str, np.ndarray]
    knots: dict[tuple[str, int], list[float]]
    gaps: dict[tuple[str, int], float]
    widths: dict[tuple[str, int], int]
    levels: DataFrame


def _factor(corr: np.ndarray) -> np.ndarray:
    """Lower triangle L with LL' = corr; a column that depends on earlier ones gets no share of its own."""
    p = len(corr)
    out = np.zeros((p, p))
    for j in range(p):
        left = corr[j, j] - out[j, :j] @ out[j, :j]
        if left > 1e-10:
            out[j, j] = left**0.5
            out[j + 1 :, j] = (corr[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j]) / out[j, j]
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def _correlation(products: np.ndarray) -> np.ndarray:
    """From sums of products of centred scores; a constant column goes with none."""
    spread = np.sqrt(np.diag(products))
    live = spread > 1e-9
    scale = np.where(live, spread, 1.0)
    corr = np.clip(products / np.outer(scale, scale), -1.0, 1.0)
    corr[~live, :] = corr[:, ~live] = 0.0
    np.fill_diagonal(corr, 1.0)
    return corr


def _products(scores: DataFrame, p: int, classes: Sequence[str]) -> dict[str, np.ndarray]:
    """Sums of products of the scores of every pair of columns, per class."""
    if p > EXPRESSION_COLUMNS:
        listed = scores.groupBy("__row", "__g").agg(F.sort_array(F.collect_list(F.struct("i", "z"))).alias("s"))
        arrays = pinned(listed.select("__g", F.col("s.z").alias("x")))
        return {g: cross_products(arrays.where(F.col("__g") == g).select("x"), p, lambda x: x, p) for g in classes}
    wide = scores.groupBy("__row", "__g").agg(*[F.max(F.when(F.col("i") == i, F.col("z"))).alias(f"z{i}") for i in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    out = {}
    for r in wide.groupBy("__g").agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).collect():
        out[r[0]] = np.zeros((p, p))
        for (i, j), v in zip(pairs, r[1:]):
            out[r[0]][i, j] = out[r[0]][j, i] = v
    return out


def fit_copula(df: DataFrame, columns: Sequence[str], group: Column | None = None) -> Copula:
    """A copula of `columns` for each value of `group` (text), all in the same jobs.

    A gap (null or NaN) counts as a value below all others, so gaps keep their share and their company. Columns that are not
    numeric are taken by their text form and ordered by it: their company is kept as far as it follows that order. Work is rows times columns; a value's rows may be any share of the table.
    """
    require(df, columns)
    names, p = list(columns), len(columns)
    numeric = [is_numeric(data_type(df, c)) for c in names]
    nested = [c for c in names if isinstance(data_type(df, c), (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if nested:
        raise TypeError(f"numbers, texts, dates or booleans expected: {', '.join(nested)}")
    none = F.lit(None)

    def value(c: str, number: bool) -> Column:
        x = F.nanvl(col(c).cast("double"), none.cast("double")) + F.lit(0.0) if number else none.cast("double")
        return F.struct(x.alias("number"), (none if number else col(c)).cast("string").alias("text"))

    held = F.array(*[value(c, n) for c, n in zip(names, numeric)]).alias("v")
    wide = pinned(df.select((F.lit(ONE) if group is None else group.cast("string")).alias("__g"), held).where("__g is not null")
                  .withColumn("__row", F.monotonically_increasing_id()))
    rows = {r[0]: r[1] for r in wide.groupBy("__g").count().collect()}
    melted = wide.select("__g", "__row", F.posexplode("v").alias("i", "value")).withColumn("column", F.struct("__g", "i"))
    counts = melted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    many = sum(rows.values()) * p
    ranks = pinned(average_ranks(counts, melted_parts(df, many)))  # scores, knots and levels all come from it
    sizes = F.create_map(*[F.lit(x) for g, n in rows.items() for x in (g, n)]) if rows else F.create_map().cast("map<string,bigint>")
    total = sizes[F.col("column.__g")]
    # mean ranks lie evenly around the middle, so the scores' mean is taken off by class and column
    scored = ranks.select("column", "value", "n", normal_score((F.col("rank") - 0.5) / total).alias("z"))
    middle = scored.groupBy("column").agg((F.sum(F.col("n") * F.col("z")) / F.sum("n")).alias("mean"))
    scored = scored.join(F.broadcast(middle), "column").select("column", "value", "n", (F.col("z") - F.col("mean")).alias("z"))
    scores = with_ranks(melted, scored, many, "z").repartition(melted_parts(df, many), "__row", "__g").select("__row", "__g", "i", "z")
    correlations = {g: _correlation(m) for g, m in _products(scores, p, list(rows)).items()}

    first = (F.col("rank") - (F.col("n") + 1) / 2).cast("bigint")  # rows below the value
    placed = ranks.select(F.col("column.__g").alias("g"), F.col("column.i").alias("i"), "value.number", "value.text", "n", first.alias("first"), total.alias("rows"))
    live = [i for i, n in enumerate(numeric) if n]
    gap_rows = placed.where(F.col("i").isin(live) & F.col("number").isNull()) if live else placed.limit(0)
    gaps = {(r["g"], r["i"]): r["n"] / r["rows"] for r in gap_rows.select("g", "i", "n", "rows").collect()}
    knots = _knots(placed.where(F.col("i").isin(live) & F.col("number").isNotNull())) if live else {}
    levels = placed.where(~F.col("i").isin(live)) if live else placed
    shape = levels.groupBy("g", "i").agg(F.greatest(F.lit(1), F.floor(F.max("rows") / F.count(F.lit(1)))).alias("width"))
    widths = {(r["g"], r["i"]): r["width"] for r in shape.collect()}
    blocks = F.sequence(F.floor(F.col("first") / F.col("width")), F.floor((F.col("first") + F.col("n") - 1) / F.col("width")))
    levels = levels.join(F.broadcast(shape), ["g", "i"]).select("g", "i", F.explode(blocks).alias("block"), "first", "n", "text")
    return Copula(names, numeric, rows, correlations, {g: _factor(c) for g, c in correlations.items()}, knots, gaps, widths, levels)


def _knots(values: DataFrame) -> dict[tuple[str, int], list[float]]:
    """Order statistics 0, (m-1)/KNOTS, 2(m-1)/KNOTS, … (rounded down) of each column's m values: each distinct value says
    which of them it is, so KNOTS + 1 rows a column are all that leaves the tasks."""
    whole = values.groupBy("g", "i").agg(F.sum("n").alias("m"), F.min("first").alias("below"))
    at = values.join(F.broadcast(whole), ["g", "i"]).withColumn("at", F.col("first") - F.col("below"))
    steps = "greatest(m - 1, 1)"
    lowest = F.expr(f"(at * {KNOTS}L + {steps} - 1) div {steps}")
    highest = F.expr(f"least(((at + n) * {KNOTS}L + {steps} - 1) div {steps} - 1, {KNOTS}L)")
    chosen = at.withColumns({"lo": lowest, "hi": F.when(F.col("m") == 1, F.lit(KNOTS).cast("bigint")).otherwise(highest)}).where("lo <= hi")
    out: dict[tuple[str, int], list[float]] = {}
    for r in chosen.select("g", "i", "lo", "hi", "number").collect():
        held = out.setdefault((r["g"], r["i"]), [0.0] * (KNOTS + 1))
        held[r["lo"] : r["hi"] + 1] = [r["number"]] * (r["hi"] - r["lo"] + 1)
    return out


def _drawn(df: DataFrame, fitted: Copula, picks: DataFrame, target: str | None, seed: int) -> DataFrame:
    """Rows like df's for every (__g, j) of picks; columns that were not fitted are NULL."""
    spark, p = df.sparkSession, len(fitted.names)
    parts = [
        (
            g,
            fitted.rows[g],
            fitted.factors[g].tolist(),
            [fitted.knots.get((g, i), []) for i in range(p)],
            [fitted.gaps.get((g, i), 0.0) for i in range(p)],
            [fitted.widths.get((g, i), 1) for i in range(p)],
        )
        for g in fitted.factors
    ]
    schema = "__g string, __rows long, __f array<array<double>>, __k array<array<double>>, __gap array<double>, __w array<long>"
    # a row per class; the driver made it, so it is no larger than what the driver holds
    held = F.broadcast(spark.createDataFrame(parts, schema))
    made = picks.withColumn("__e", F.array(*[gauss(f"{seed}c{i}", F.col("__g"), F.col("j")) for i in range(p)])).join(held, "__g")

    def share(i: int) -> Column:
        terms = F.zip_with(F.col("__f")[i], F.col("__e"), lambda a, b: a * b)
        return normal_share(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))

    made = made.withColumns({f"__u{i}": share(i) for i in range(p)})
    found = {}
    for i, (name, number) in enumerate(zip(fitted.names, fitted.numeric)):
        u, kind = F.col(f"__u{i}"), data_type(df, name)
        if number:
            gap, line = F.col("__gap")[i], F.col("__k")[i]
            at = F.least((u - gap) / (F.lit(1.0) - gap), F.lit(1.0)) * KNOTS
            step = F.least(F.floor(at), F.lit(KNOTS - 1)).cast("int")
            low, high = F.get(line, step), F.get(line, step + 1)
            x = F.when((u >= gap) & (gap < 1.0), low + (at - step) * (high - low))
            found[name] = F.round(x).cast(kind) if isinstance(kind, T.IntegralType) else x.cast(kind)
        else:
            rank = F.least(F.floor(u * F.col("__rows")), F.col("__rows") - 1)
            made = made.withColumns({f"__r{i}": rank, f"__b{i}": F.floor(rank / F.col("__w")[i])})
            level = fitted.levels.where(F.col("i") == i).select(
                F.col("g").alias("__lg"), "block", "first", "n", F.col("text").alias(f"__t{i}")
            )
            here = (F.col(f"__r{i}") >= F.col("first")) & (F.col(f"__r{i}") < F.col("first") + F.col("n"))
            made = made.join(level, (F.col("__g") == F.col("__lg")) & (F.col(f"__b{i}") == F.col("block")) & here).drop("__lg", "block", "first", "n")
            found[name] = F.col(f"__t{i}").cast(kind)
    out = []
    for c in df.columns:
        kind = data_type(df, c)
        x = found[c] if c in found else F.col("__g").cast(kind) if c == target else F.lit(None).cast(kind)
        out.append(x.alias(c))
    return made.select(*out)


def copula_rows(df: DataFrame, no_of_samples: int = 200, seed: int = 5, skip: Sequence[str] = ()) -> DataFrame:
    """All rows and `no_of_samples` generated ones; `skip` columns are NULL there. An empty table gains none."""
    if no_of_samples < 1:
        return df
    fitted = fit_copula(df, [c for c in df.columns if c not in skip])
    # ids are above 0; a bare literal would be folded into the join of the class's numbers and leave it without a key
    picks = df.sparkSession.range(1, int(no_of_samples) + 1).select(F.when(F.col("id") > 0, F.lit(ONE)).alias("__g"), F.col("id").alias("j"))
    return df.unionByName(_drawn(df, fitted, picks, None, seed))


def copula_class(df: DataFrame, target: str, seed: int = 5, skip: Sequence[str] = ()) -> DataFrame:
    """All rows, and generated rows that fill every class up to the largest, each class from its own copula."""
    counts = held_counts(df, target)
    most = max(counts.values(), default=0)
    need = {c: most - n for c, n in counts.items() if n < most}
    if not need:
        return df
    names = [c for c in df.columns if c != target and c not in skip]
    fitted = fit_copula(df.where(col(target).isin(*need)), names, col(target))
    picks = draws(df.sparkSession, need, target, data_type(df, target)).select(col(target).cast("string").alias("__g"), "j")
    return df.unionByName(_drawn(df, fitted, picks, target, seed))


def copula_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr): correlation of the normal scores of every pair, ties sharing their mean rank."""
    fitted = fit_copula(df, columns)
    pairs = [(i, j) for i in range(len(fitted.names)) for j in range(i + 1, len(fitted.names))]
    rows = [(fitted.names[i], fitted.names[j], float(c[i, j])) for c in fitted.correlations.values() for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")
