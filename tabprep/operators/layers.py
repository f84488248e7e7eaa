"""A layered index over points: pivots of pivots lead to a row's cell and to the cells around a query.

Fitted on a bounded sample per group; every point is put into a cell. Finding cells costs about the square root of their number, so
the work of a row is sqrt(cells) + cells searched * rows of a cell instead of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.choose import mapped
from ..functions.hashing import SPAN, hash32

SAMPLE = 65_536  # points fetched to place pivots, over all groups; a small group gives 256 at least
CELL_ROWS = 512  # points a cell is meant to hold
MAX_CELLS = 65_536  # over all groups
MAX_GROUPS = 2_000
WIDE = 6  # upper pivots whose cells a query weighs
ROUNDS = 4


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None]


def _settled(x: np.ndarray, k: int) -> np.ndarray:
    """k centres of a sample by a few rounds of moving them to their points' mean; the first k points start."""
    centres = x[: min(k, len(x))].copy()
    for _ in range(ROUNDS if len(centres) < len(x) else 0):
        at = _squared(x, centres).argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Layers:
    """Upper pivots, the cells' pivots under each, and the number of the first cell under each."""

    top: np.ndarray
    below: list[np.ndarray]
    first: np.ndarray

    @staticmethod
    def of(x: np.ndarray, cells: int, start: int) -> "Layers":
        top = _settled(x, max(1, round(cells**0.5)))
        at = _squared(x, top).argmin(axis=1)
        below = [_settled(part, max(1, round(cells * len(part) / len(x)))) if len(part := x[at == t]) else top[t : t + 1] for t in range(len(top))]
        return Layers(top, below, start + np.cumsum([0, *[len(b) for b in below[:-1]]]))

    def __len__(self) -> int:
        return sum(map(len, self.below))

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row: under its nearest upper pivot, the nearest."""
        at = _squared(x, self.top).argmin(axis=1)
        out = np.empty(len(x), np.int64)
        for t in np.unique(at):
            rows = np.flatnonzero(at == t)
            out[rows] = self.first[t] + _squared(x[rows], self.below[t]).argmin(axis=1)
        return out

    def around(self, x: np.ndarray, probes: int, least: int, sizes: np.ndarray) -> list[np.ndarray]:
        """Per row its nearest cells: `probes` of them, and on until they hold `least` points or are all."""
        tops = np.argsort(_squared(x, self.top), axis=1, kind="stable")[:, :WIDE]
        far = [np.full((len(x), len(b)), np.inf) for b in self.below]
        for t in np.unique(tops):
            rows = np.flatnonzero((tops == t).any(axis=1))
            far[t][rows] = _squared(x[rows], self.below[t])
        far = np.concatenate(far, axis=1)
        start, out = int(self.first[0]), []
        for i in range(len(x)):
            order = np.flatnonzero(np.isfinite(far[i]))
            if sizes[start + order].sum() < least:  # hardly any point near: weigh all cells
                order = np.arange(far.shape[1])
                far[i] = _squared(x[i : i + 1], np.concatenate(self.below))[0]
            order = order[np.argsort(far[i, order], kind="stable")]
            order = order[sizes[start + order] > 0]
            enough = int(np.searchsorted(np.cumsum(sizes[start + order]), least)) + 1
            out.append(start + order[: max(probes, enough)])
        return out


def fit_layers(points: DataFrame, seed: int, cell_rows: int = CELL_ROWS) -> dict[str, Layers]:
    """Layers of every group of points (g, x, s, key), from a sample drawn by hash of the key."""
    sizes = {r["g"]: r["n"] for r in points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()}
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: search them in parts")
    if not sizes:
        return {}
    whole = sum(sizes.values())
    bars = {g: min(SPAN, int(max(256, SAMPLE * n / whole) / n * SPAN)) for g, n in sizes.items()}
    drawn = points.withColumn("__h", hash32(seed, F.col("key"))).where(F.col("__h") < mapped(F.col("g"), bars)).select("g", "x", "__h").toPandas()
    missed = [points.where(F.col("g") == g).limit(1).select("g", "x", F.lit(0).alias("__h")).toPandas() for g in set(sizes) - set(drawn["g"])]
    drawn = pd.concat([drawn, *missed])
    out, start = {}, 0
    for g, part in sorted(drawn.groupby("g")):
        x = np.stack(part.sort_values("__h", kind="stable")["x"].to_numpy())
        x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]  # distinct points in the order of their hash
        cells = max(1, min(-(-sizes[g] // cell_rows), int(MAX_CELLS * sizes[g] / whole) or 1, len(x)))
        out[g] = Layers.of(x, cells, start)
        start += len(out[g])
    return out


def with_cells(points: DataFrame, layers: dict[str, Layers]) -> DataFrame:
    """Every point with its cell."""
    held = points.sparkSession.sparkContext.broadcast(layers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, rows in batch.groupby("g"):
                if g in held.value:
                    yield rows.assign(target=held.value[g].cell(np.stack(rows["x"].to_numpy())).astype("int32"))

    return points.mapInPandas(place, T.StructType([*points.schema.fields, T.StructField("target", T.IntegerType())]))


def routed(places: DataFrame, layers: dict[str, Layers], probes: int, least: int, sizes: dict[int, int]) -> DataFrame:
    """One row per place and cell to search."""
    n = np.zeros(sum(map(len, layers.values())), np.int64)
    n[list(sizes)] = list(sizes.values())
    held = places.sparkSession.sparkContext.broadcast((layers, n))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = held.value
        for batch in batches:
            for g, rows in batch.groupby("g"):
                for start in range(0, len(rows) if g in known else 0, 1024):
                    part = rows.iloc[start : start + 1024]
                    cells = known[g].around(np.stack(part["x"].to_numpy()), probes, least, counts)
                    times = [len(c) for c in cells]
                    yield part.loc[part.index.repeat(times)].assign(target=np.concatenate(cells).astype("int32"))

    return places.mapInPandas(route, T.StructType([*places.schema.fields, T.StructField("target", T.IntegerType())]))


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """Share of the exact neighbours (key, neighbour) that `found` has too."""
    both = exact.select(key, "neighbour").join(found.select(key, "neighbour"), [key, "neighbour"], "left_semi")
    whole = exact.count()
    return both.count() / whole if whole else 1.0
