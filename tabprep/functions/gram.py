"""Cross products and covariances of numeric columns.

A few columns are summed by native expressions. Many are multiplied block by block: a task adds up the upper triangle of the
product in blocks of BLOCK columns and emits each block as one value; the tasks' blocks are summed in two stages of streaming
reducers, so nobody holds more than one sum at a time. Beyond DRIVER_COLUMNS the square itself would not fit the driver:
`top_components` then finds leading components from tall, thin products only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import col, require_numeric

EXPRESSION_COLUMNS = 24  # beyond this, p*(p+1)/2 aggregates outgrow generated code
BLOCK = 256  # columns of a block: 512 kB
HELD_BLOCKS = 512  # blocks a task sums in one pass; more take another pass
DRIVER_COLUMNS = 8_192  # a square of 512 MB
FAN = 64  # first-stage reducers of each block

PART = "i int, j int, turn long, v binary"


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, rows with a gap left out."""
    return df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()


def packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All columns as one array `x` of doubles."""
    return df.select(F.array(*[col(c).cast("double") for c in columns]).alias("x"))


def matrices(batches: Iterable[pa.RecordBatch], p: int, gaps: bool = False) -> Iterator[np.ndarray]:
    """Batches of `x` as rows x p; null is NaN, and rows with a gap are left out unless `gaps`."""
    for batch in batches:
        x = batch.column(0).values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, p)
        yield x if gaps else x[~np.isnan(x).any(axis=1)]


def _reduced(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sum of the parts of every (i, j): streaming reducers per (i, j, some of the tasks), then per (i, j)."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield (row["i"], row["j"], row["turn"] % FAN), np.frombuffer(row["v"])

        for (i, j, turn), group in groupby(rows(), key=lambda r: r[0]):
            total = next(group)[1].copy()
            for _, v in group:
                total += v
            columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([turn], pa.int64()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "turn", "v"])

    first = parts.withColumn("some", F.col("turn") % FAN).repartition("i", "j", "some").sortWithinPartitions("i", "j", "some", "turn").drop("some")
    last = first.mapInArrow(summed, PART).withColumn("place", F.col("turn")).withColumn("turn", F.lit(0).cast("bigint"))
    last = last.repartition("i", "j").sortWithinPartitions("i", "j", "place").drop("place").mapInArrow(summed, PART)
    return {(r["i"], r["j"]): np.frombuffer(r["v"]) for r in last.toLocalIterator()}


def cross_products(rows: DataFrame, p: int, shaped: Callable[[np.ndarray], np.ndarray], q: int, gaps: bool = False) -> np.ndarray:
    """Z'Z for Z = shaped(X), q columns made of the p of each row of `rows` (array x)."""
    if q > DRIVER_COLUMNS:
        raise ValueError(f"{q} columns: their square is beyond the driver; use fewer, or top_components")
    edges = [(a, min(a + BLOCK, q)) for a in range(0, q, BLOCK)]
    pairs = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]
    out = np.zeros((q, q))
    for start in range(0, len(pairs), HELD_BLOCKS):
        chosen = pairs[start : start + HELD_BLOCKS]

        def partial(batches: Iterable[pa.RecordBatch], chosen: list = chosen) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held: dict[tuple[int, int], np.ndarray] = {}
            for x in matrices(batches, p, gaps):
                z = shaped(x)
                for i, j in chosen:
                    product = z[:, slice(*edges[i])].T @ z[:, slice(*edges[j])]
                    held[i, j] = held[i, j] + product if (i, j) in held else product
            turn = TaskContext.get().partitionId()
            for (i, j), v in held.items():
                columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([turn], pa.int64()), pa.array([v.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "turn", "v"])

        for (i, j), v in _reduced(rows.mapInArrow(partial, PART)).items():
            (a, b), (c, d) = edges[i], edges[j]
            out[a:b, c:d] = v.reshape(b - a, d - c)
            out[c:d, a:b] = out[a:b, c:d].T
    return out


def _tall(rows: DataFrame, p: int, width: int, shaped: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over batches of shaped(X), p x width, in row blocks."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for x in matrices(batches, p):
            total = shaped(x) if total is None else total + shaped(x)
        turn = TaskContext.get().partitionId()
        for i, a in enumerate(range(0, p, BLOCK) if total is not None else ()):
            columns = [pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([turn], pa.int64()), pa.array([total[a : a + BLOCK].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "turn", "v"])

    out = np.zeros((p, width))
    for (i, _), v in _reduced(rows.mapInArrow(partial, PART)).items():
        out[i * BLOCK : (i + 1) * BLOCK] = v.reshape(-1, width)
    return out


def means_of(rows: DataFrame, p: int) -> tuple[int, np.ndarray]:
    """(complete rows, their means)."""
    sums = _tall(rows, p, 2, lambda x: np.stack([x.sum(axis=0), np.full(p, float(len(x)))], axis=1))
    n = int(sums[0, 1])
    return n, sums[:, 0] / max(n, 1)


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """X'X over complete rows, without an intercept."""
    require_numeric(df, columns)
    p = len(columns)
    if p > EXPRESSION_COLUMNS:
        return cross_products(packed(df, columns), p, lambda x: x, p)
    rows = _complete(df, columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = rows.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((p, p))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v or 0.0
    return out


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population covariance) over complete rows."""
    require_numeric(df, columns)
    p = len(columns)
    if p > EXPRESSION_COLUMNS:
        rows = packed(df, columns)
        n, means = means_of(rows, p)
        return n, means, cross_products(rows, p, lambda x: x - means, p) / max(n, 1)
    rows = _complete(df, columns)
    basics = [F.count(F.lit(1)), *[F.avg(f"x{i}") for i in range(p)]]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = rows.agg(*basics, *[F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs]).first()
    out = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[p + 1 :]):
        out[i, j] = out[j, i] = v or 0.0
    return row[0], np.array([m or 0.0 for m in row[1 : p + 1]]), out


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlation of every pair over the rows where both are present; NaN where it is undefined.

    One pass multiplies the numbers (around each column's mean, gaps as 0), their squares and the marks of presence.
    """
    require_numeric(df, columns)
    p, rows = len(columns), packed(df, columns)
    means = []
    for start in range(0, p, 400):
        means += df.agg(*[F.avg(F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))) for c in columns[start : start + 400]]).first()
    shift = np.array([m or 0.0 for m in means])

    def shaped(x: np.ndarray) -> np.ndarray:
        there = ~np.isnan(x)
        z = np.where(there, x - shift, 0.0)
        return np.concatenate([z, there.astype(float), z * z], axis=1)

    g = cross_products(rows, p, shaped, 3 * p, gaps=True)
    both, sums = g[p : 2 * p, p : 2 * p], g[:p, p : 2 * p]  # rows of each pair; sum of i where j is there
    squares = g[2 * p :, p : 2 * p]
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = squares - sums * sums / both
        spread[spread <= 1e-14 * squares] = 0.0  # what is left of a constant column
        out = (g[:p, :p] - sums * sums.T / both) / np.sqrt(spread * spread.T)
    out[~np.isfinite(out)] = np.nan
    return np.clip(out, -1.0, 1.0)


def top_components(
    df: DataFrame, columns: Sequence[str], k: int, spare: int = 16, tolerance: float = 1e-11, passes: int = 60, seed: int = 5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, loadings by row) of the k leading principal components, without the columns' square.

    Randomised range finder with subspace iteration (Halko et al. 2011): a pass multiplies the covariance with k + `spare`
    directions, rows times thin matrices only; it ends when a pass turns the k leading directions by less than `tolerance`, in
    two passes where the other directions carry nothing, or after `passes`. The largest loading of a row is positive.
    """
    require_numeric(df, columns)
    p = len(columns)
    if not 0 < k <= p:
        raise ValueError("number of components must lie between 1 and the number of columns")
    rows = packed(df, columns)
    n, means = means_of(rows, p)
    width = min(p, k + spare)
    base = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))[0]
    lead = None
    for _ in range(max(2, passes)):

        def pressed(x: np.ndarray, base: np.ndarray = base) -> np.ndarray:
            z = x - means
            return z.T @ (z @ base)

        image = _tall(rows, p, width, pressed) / max(n, 1)
        inner = base.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(values)[::-1][:k]
        found = base @ turn[:, order]
        moved = np.inf if lead is None else np.linalg.norm(found - lead @ (lead.T @ found), ord=2)
        lead = found
        if moved < tolerance:
            break
        base = np.linalg.qr(image)[0]
    loadings = lead.T
    signs = np.sign(loadings[np.arange(k), np.abs(loadings).argmax(axis=1)])
    return means, values[order], loadings * signs[:, None]
