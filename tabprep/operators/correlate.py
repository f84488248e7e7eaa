"""Correlations of column pairs: Pearson, Spearman, Kendall, Cramér's V and phi_k.

Pearson and Spearman are cross products. The others work on cells: the distinct (x, y) of each pair with their row count.
Cells of all pairs are made in one shuffle with map-side counts, and every later step is keyed by pair, so the number of jobs
does not grow with the columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import col, data_type, is_numeric, require, require_numeric
from ..functions.gram import EXPRESSION_COLUMNS, cross_products, gram_matrix, packed, pairwise_correlation
from ..functions.levels import value_counts
from ..plans.pipeline import WAVE_WIDTH, Pipeline, run_aggregates
from ..session import pinned, shuffle_width
from .bins import Bin
from .rank import LOW_BITS, global_rank


def _pairs(df: DataFrame, rows: list[tuple[str, str, float | None]]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def corr_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every pair, over rows where both are present.

    A few hundred pairs are native aggregates of one pass; more come from blockwise cross products, also of one pass.
    """
    require_numeric(df, columns)
    pairs = list(combinations(columns, 2))
    if len(pairs) > WAVE_WIDTH:
        corr = pairwise_correlation(df, columns)
        both = [(a, b, float(corr[i, j])) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
        return _pairs(df, [(a, b, None if math.isnan(v) else v) for a, b, v in both])
    found = run_aggregates(df, {f"{i}": F.corr(col(a), col(b)) for i, (a, b) in enumerate(pairs)})
    return _pairs(df, [(a, b, found[f"{i}"]) for i, (a, b) in enumerate(pairs)])


TASK_ROWS = 1_000_000  # melted rows a task matches with ranks, or brings together by row
HOT_VALUES = 10_000  # values that are answered by broadcast; any other has less than this share of all melted rows


def melted_parts(df: DataFrame, rows: int) -> int:
    """Partitions for so many melted rows, so that a task's memory does not grow with them."""
    return max(shuffle_width(df.sparkSession), -(-rows // TASK_ROWS))


def with_ranks(melted: DataFrame, ranks: DataFrame, rows: int, *names: str) -> DataFrame:
    """The melted rows (…, column, value) with `names` of their value in the stored table `ranks` (column, value, n, names).

    `rows` is the number of melted rows. Values that many of them have are met by broadcast, all others in partitions of TASK_ROWS
    rows, so no task sorts the rows of a frequent value.
    """
    parts, on = melted_parts(melted, rows), ["column", "value"]
    often = F.col("n") > F.lit(rows / HOT_VALUES)
    hot = F.broadcast(ranks.where(often).select(*on, *names))
    rest = melted.join(hot.select(*on), on, "left_anti").repartition(parts, *on)
    return melted.join(hot, on).unionByName(rest.join(ranks.where(~often).select(*on, *names).repartition(parts, *on).hint("merge"), on))


def average_ranks(counts: DataFrame, parts: int) -> DataFrame:
    """(column, value, n, rank) from value counts: tied values share the mean of their positions.

    Distinct values are spread by range over `parts`; each partition runs its own sum on top of the partitions before it.
    """
    placed = pinned(
        counts.repartitionByRange(parts, "column", "value")
        .sortWithinPartitions("column", "value")
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(LOW_BITS))
    placed = placed.withColumn("__part", part).withColumn("__place", place)
    earlier = W.partitionBy("column").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("column", "__part")
        .agg(F.sum("n").alias("__rows"))
        .withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
        .drop("__rows")
    )
    upto = W.partitionBy("column", "__part").orderBy("__place").rowsBetween(W.unboundedPreceding, -1)
    running = placed.repartition(parts, "column", "__part").withColumn("__run", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    return running.join(starts, ["column", "__part"]).select(
        "column", "value", "n", (F.col("__before") + F.col("__run") + (F.col("n") + 1) / 2).alias("rank")
    )


def pair_cells(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(pair, x, y, w): rows of each pair of columns by its two values, as `kind`; pairs count as combinations() does."""
    narrow = df.select(*[col(c).cast(kind).alias(f"v{i}") for i, c in enumerate(columns)])
    listed = [
        F.struct(F.lit(p).alias("pair"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
        for p, (i, j) in enumerate(combinations(range(len(columns)), 2))
    ]
    rows = narrow.select(F.inline(F.array(*listed))).na.drop()
    return pinned(rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")))


def _sided(cells: DataFrame, table: DataFrame, name: str, n_columns: int) -> DataFrame:
    """Add x_<name> and y_<name>: what `table` (column number, value) says of either value."""
    sides = list(combinations(range(n_columns), 2))
    out = cells
    for side, place in (("x", 0), ("y", 1)):
        number = F.element_at(F.array(*[F.lit(s[place]) for s in sides]), F.col("pair") + 1)
        known = table.select(F.col("column").alias("__column"), F.col("value").alias("__value"), F.col(name).alias(f"{side}_{name}"))
        out = out.join(known, (number == F.col("__column")) & (F.col(side) == F.col("__value"))).drop("__column", "__value")
    return out


def _column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column number, value, n) of numeric columns as doubles."""
    counts = value_counts(df, {str(i): col(c).cast("double") for i, c in enumerate(columns)})["double"]
    return counts.withColumn("column", F.col("column").cast("int"))


def _filled(columns: Sequence[str], found: dict[int, float | None]) -> list[tuple[str, str, float | None]]:
    return [(a, b, found.get(p)) for p, (a, b) in enumerate(combinations(columns, 2))]


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks over complete rows.

    Every column is ranked once, over its distinct values; rows are then melted to (row, column, value), meet the ranks, and come
    together again as one array each. The work is rows times columns, and all pairs are one cross product.
    """
    require_numeric(df, columns)
    p = len(columns)
    whole = packed(df, columns).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    rows = pinned(whole.withColumn("__row", F.monotonically_increasing_id()))
    n = rows.count()
    middle = (n + 1) / 2  # of every column's ranks; ranks around it keep the sums small
    melted, many = rows.select("__row", F.posexplode("x").alias("column", "value")), n * p
    parts = melted_parts(df, many)
    ranks = average_ranks(melted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), parts)
    ranks = pinned(ranks.select("column", "value", "n", (F.col("rank") - middle).alias("off")))
    ranked = with_ranks(melted, ranks, many, "off").repartition(parts, "__row")
    if p <= EXPRESSION_COLUMNS:  # a buffer of p numbers per melted row is small
        names = [f"r{i}" for i in range(p)]
        products = gram_matrix(ranked.groupBy("__row").agg(*[F.max(F.when(F.col("column") == i, F.col("off"))).alias(c) for i, c in enumerate(names)]), names)
    else:
        listed = ranked.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("column", "off"))).alias("ranks"))
        products = cross_products(listed.select(F.col("ranks.off").alias("x")), p, lambda x: x, p)
    found = {}
    for pair, (i, j) in enumerate(combinations(range(p), 2)):
        size = math.sqrt(products[i, i] * products[j, j])
        found[pair] = float(products[i, j] / size) if size else None
    return _pairs(df, _filled(columns, found))


def _whole(name: str) -> Column:
    """A count whose products are summed exactly."""
    return F.col(name).cast("decimal(19,0)")


def concordant(cells: DataFrame, nx: int, ny: int) -> dict[int, int]:
    """Per pair of columns the number of row pairs that rise in both, from cells (pair, xr, yr, w) of coded values.

    Two different yr differ first at one bit: below equal higher bits one has 0, the other 1. So each
    cell appears once per bit, and a pair rises when the 0 has the smaller xr: a running sum of the
    zeros in xr order within each (bit, prefix). Runs are cut into ranges of xr, so even the one run
    of the highest bit is spread; the work is cells times bits, never cells squared.
    """
    bits = max(1, (ny - 1).bit_length())
    width = max(1, -(-nx // (4 * shuffle_width(cells.sparkSession))))
    level = cells.select("pair", "xr", "yr", "w", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    # integer division by a power of two is the shift that a column of bits needs
    scaled = F.floor(F.col("yr") / F.pow(F.lit(2.0), F.col("bit"))).cast("bigint")
    level = level.withColumn("scaled", scaled)
    grouped = (
        level.groupBy("pair", "bit", F.floor(F.col("scaled") / 2).alias("prefix"), "xr")
        .agg(
            F.sum(F.when(F.col("scaled") % 2 == 0, F.col("w")).otherwise(0)).alias("zeros"),
            F.sum(F.when(F.col("scaled") % 2 == 1, F.col("w")).otherwise(0)).alias("ones"),
        )
        .withColumn("range", F.floor(F.col("xr") / F.lit(width)))
    )
    run = W.partitionBy("pair", "bit", "prefix", "range").orderBy("xr").rowsBetween(W.unboundedPreceding, -1)
    inner = grouped.withColumn("before", F.coalesce(F.sum("zeros").over(run), F.lit(0)))
    # pairs inside a range, then whole earlier ranges
    per_range = inner.groupBy("pair", "bit", "prefix", "range").agg(
        F.sum(_whole("ones") * _whole("before")).alias("inside"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")
    )
    earlier = W.partitionBy("pair", "bit", "prefix").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    whole = per_range.withColumn("earlier", F.coalesce(F.sum("zeros").over(earlier), F.lit(0)))
    found = whole.groupBy("pair").agg(F.sum(F.col("inside") + _whole("ones") * _whole("earlier")).alias("up")).collect()
    return {r["pair"]: int(r["up"] or 0) for r in found}


def corr_kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tau-b of every pair of numeric columns, exact, in n log n work."""
    require_numeric(df, columns)
    cells = pair_cells(df, columns, "double")

    def tied(*keys: str) -> dict[int, int]:
        g = cells.groupBy("pair", *keys).agg(F.sum("w").alias("t")).withColumn("less", F.col("t") - 1)
        return {r["pair"]: int(r["n"] or 0) // 2 for r in g.groupBy("pair").agg(F.sum(_whole("t") * _whole("less")).alias("n")).collect()}

    sizes = {r["pair"]: r["n"] for r in cells.groupBy("pair").agg(F.sum("w").alias("n")).collect()}
    if not sizes:
        return _pairs(df, _filled(columns, {}))
    codes = pinned(global_rank(_column_counts(df, columns), ["value"], ["value"], "code", by=["column"]))
    most = codes.groupBy("column").count().agg(F.max("count")).first()[0]
    coded = _sided(cells, codes, "code", len(columns)).select("pair", F.col("x_code").alias("xr"), F.col("y_code").alias("yr"), "w")
    ups, tx, ty, txy = concordant(coded, most, most), tied("x"), tied("y"), tied("x", "y")
    found = {}
    for pair, n in sizes.items():
        whole, up = n * (n - 1) // 2, ups.get(pair, 0)
        down = whole - tx[pair] - ty[pair] + txy[pair] - up
        size = math.sqrt((whole - tx[pair]) * (whole - ty[pair]))
        found[pair] = (up - down) / size if size else None
    return _pairs(df, _filled(columns, found))


def chi_squares(df: DataFrame, columns: Sequence[str]) -> dict[int, tuple[float, float, int, int]]:
    """Per pair (chi², rows, levels of the first, levels of the second) from the contingency counts and their margins."""
    cells = pair_cells(df, columns, "string").withColumn("o", F.col("w").cast("double"))
    mx = cells.groupBy("pair", "x").agg(F.sum("o").alias("mx"))
    my = cells.groupBy("pair", "y").agg(F.sum("o").alias("my"))
    sums = cells.join(mx, ["pair", "x"]).join(my, ["pair", "y"]).groupBy("pair")
    sums = sums.agg(F.sum(F.col("o") * F.col("o") / (F.col("mx") * F.col("my"))).alias("s"), F.sum("o").alias("n"))
    levels = mx.groupBy("pair").agg(F.count(F.lit(1)).alias("r")).join(my.groupBy("pair").agg(F.count(F.lit(1)).alias("k")), "pair")
    return {
        r["pair"]: (max(0.0, r["n"] * (r["s"] - 1)), r["n"], r["r"], r["k"]) for r in sums.join(levels, "pair").collect()
    }


def cramers_v(chi2: float, n: float, r: int, k: int) -> float | None:
    """Bias-corrected Cramér's V."""
    if n < 2:
        return None
    phi2 = max(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
    least = min(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1)
    return math.sqrt(phi2 / least) if least > 0 else None


def corr_cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, columns)
    return _pairs(df, _filled(columns, {p: cramers_v(*c) for p, c in chi_squares(df, columns).items()}))


@cache
def _normal_knots() -> tuple[np.ndarray, np.ndarray]:
    """The standard normal distribution at points so close that straight lines between them err by less than 1e-9."""
    knots = np.linspace(-40, 40, 1_000_001)
    return knots, np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in knots.tolist()])


def _normal_table(rho: float, nx: int, ny: int) -> np.ndarray:
    """Probabilities of a standard bivariate normal in nx × ny even bins of [-5, 5]."""
    knots, below = _normal_knots()
    nodes, weights = np.polynomial.legendre.leggauss(40)
    xs, ys = np.linspace(-5, 5, nx + 1), np.linspace(-5, 5, ny + 1)
    out = np.zeros((nx, ny))
    spread = math.sqrt(1 - rho * rho)
    for i in range(nx):
        half = (xs[i + 1] - xs[i]) / 2
        at = xs[i] + half * (nodes + 1)
        share = np.diff(np.interp((ys[None, :] - rho * at[:, None]) / spread, knots, below), axis=1)
        out[i] = half * ((weights * np.exp(-at * at / 2) / math.sqrt(2 * math.pi))[:, None] * share).sum(axis=0)
    return out / out.sum()


def _normal_chi2(rho: float, nx: int, ny: int) -> float:
    table = _normal_table(rho, nx, ny)
    free = np.outer(table.sum(axis=1), table.sum(axis=0))
    return float(((table - free) ** 2 / free).sum())


def phi_k(chi2: float, n: float, nx: int, ny: int) -> float:
    """The correlation of a bivariate normal that gives the observed chi² (Baak et al. 2018)."""
    if nx < 2 or ny < 2:
        return 0.0
    noise = (nx - 1) * (ny - 1)
    most = n * min(nx - 1, ny - 1)
    if chi2 <= noise:
        return 0.0
    top = _normal_chi2(0.9999, nx, ny)
    wanted = min(1.0, (chi2 - noise) / max(most - noise, 1e-12)) * top
    low, high = 0.0, 0.9999
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if _normal_chi2(middle, nx, ny) < wanted else (low, middle)
    return (low + high) / 2


def corr_phi_k(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """phi_k of every pair; numeric columns are cut into even bins first."""
    require(df, columns)
    numeric = [c for c in columns if is_numeric(data_type(df, c))]
    narrow = df.select(*[col(c) for c in columns])
    binned = Pipeline([Bin(c, "kbins", bins) for c in numeric]).fit(narrow).transform(narrow)
    return _pairs(df, _filled(columns, {p: phi_k(*c) for p, c in chi_squares(binned, columns).items()}))
