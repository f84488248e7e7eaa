"""Trees as plain tables of nodes: grown extremely random, read from pyspark.ml models, and explained by exact Shapley values."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..functions.hashing import SPAN
from ..session import scratch_path
from .models import PREDICTION, MlModel, decoded

TRIES = 8  # cuts drawn per feature of a node; the first that leaves enough rows on both sides counts
LEVEL_CELLS = 4_000_000  # sums that one job may bring to the driver; more trees take another job
TABLE_BITS = 16  # paths of up to so many features look their patterns up in a table


@dataclass
class Tree:
    """Nodes by number, 0 the root. A row goes left where its feature is at most the threshold, right otherwise or where it is
    missing; a leaf has feature -1. `cover` is the weight of the training rows, `value` holds one number per output."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(nodes: dict[str, list]) -> "Tree":
        whole = ("feature", "left", "right")
        return Tree(**{k: np.asarray(v, np.int64 if k in whole else float) for k, v in nodes.items()})

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            low = x[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(low, self.left[at], self.right[at])

    def mean(self) -> np.ndarray:
        """The outputs' mean over the training rows."""
        leaves = self.feature < 0
        return self.cover[leaves] @ self.value[leaves] / self.cover[0]

    def paths(self) -> list["Path"]:
        out, todo = [], [(0, {})]
        while todo:
            node, tests = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                out.append(Path(list(tests), [t[0] for t in tests.values()], [t[1] for t in tests.values()], tuple(t[2] for t in tests.values()), self.value[node]))
                continue
            cut = float(self.threshold[node])
            low, high, share = tests.get(f, (None, None, 1.0))
            for child, bounds in ((self.left[node], (low, cut if high is None else min(high, cut))), (self.right[node], (cut if low is None else max(low, cut), high))):
                part = float(self.cover[child] / self.cover[node]) if self.cover[node] else 0.0
                todo.append((int(child), {**tests, f: (*bounds, share * part)}))
        return out


@dataclass
class Path:
    """The way to one leaf: per feature the interval (low, high] it must lie in and the share of rows that pass its splits."""

    features: list[int]
    lows: list[float | None]
    highs: list[float | None]
    shares: tuple[float, ...]
    value: np.ndarray

    def met(self, x: np.ndarray) -> np.ndarray:
        """Per row the features whose tests hold, as bits."""
        out = np.zeros(len(x), np.int64)
        for bit, (f, low, high) in enumerate(zip(self.features, self.lows, self.highs)):
            holds = np.ones(len(x), bool)
            if low is not None:
                holds &= ~(x[:, f] <= low)
            if high is not None:
                holds &= x[:, f] <= high
            out |= holds.astype(np.int64) << bit
        return out


@lru_cache(maxsize=1 << 16)
def path_weights(met: int, shares: tuple[float, ...]) -> tuple[float, ...]:
    """What each feature of a path adds to the chance to reach its leaf, averaged over all orders in which features get known.

    A known feature passes its splits or not (its bit in `met`), an unknown one passes with its share. The sum over all sets
    of known features is taken by their number: multiplying in one feature after the other extends the sums (Lundberg et al. 2020).
    """
    m = len(shares)
    order = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    out = []
    for j in range(m):
        sums = [1.0]
        for k in range(m):
            if k != j:
                longer = [shares[k] * s for s in sums] + [0.0]
                if met >> k & 1:
                    for s, v in enumerate(sums):
                        longer[s + 1] += v
                sums = longer
        out.append(((met >> j & 1) - shares[j]) * sum(w * s for w, s in zip(order, sums)))
    return tuple(out)


def contributions(paths: Sequence[Path], x: np.ndarray, output: int) -> np.ndarray:
    """rows x features: the exact Shapley values of one tree's output."""
    out = np.zeros(x.shape)
    for path in paths:
        m, value = len(path.features), float(path.value[output])
        if not m or not value:
            continue
        met = path.met(x)
        if m <= TABLE_BITS:
            seen = np.zeros(1 << m, bool)
            seen[met] = True
            patterns, place = np.flatnonzero(seen), np.cumsum(seen)[met] - 1
        else:
            patterns, place = np.unique(met, return_inverse=True)
        table = np.array([path_weights(int(p), path.shares) for p in patterns]) * value
        out[:, path.features] += table[place]
    return out


@dataclass
class TreeModel:
    """Weighted sum of trees' values. For classes: one output per class, the largest decides, or one margin for the second."""

    features: list[str]
    nodes: list[dict[str, list]]
    weights: list[float]
    labels: list[Any] | None = None
    streams: bool = field(default=True, repr=False)

    def trees(self) -> list[Tree]:
        return [Tree.of(n) for n in self.nodes]

    def transform(self, df: DataFrame) -> DataFrame:
        trees, weights, classes = self.trees(), self.weights, len(self.labels or ())

        @F.pandas_udf("double")
        def answer(rows: pd.DataFrame) -> pd.Series:
            x = rows.to_numpy(dtype=float)
            sums = sum(w * t.value[t.leaf_of(x)] for w, t in zip(weights, trees))
            if not classes:
                return pd.Series(sums[:, 0])
            return pd.Series((sums.argmax(axis=1) if sums.shape[1] == classes else sums[:, 0] > 0).astype(float))

        said = answer(_numbers(self.features))
        return df.withColumn(PREDICTION, decoded(said, self.labels) if self.labels is not None else said)


def _numbers(features: Sequence[str]) -> Column:
    """The features as one struct of doubles; null reaches numpy as NaN."""
    return F.struct(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])


# -- pyspark.ml models ------------------------------------------------------------------------------


def _spark_nodes(spark: SparkSession, model: Any, shares: bool) -> list[dict[str, list]]:
    """Node tables from the model's own files; `shares` turns class counts into shares, else a node's prediction counts."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    rows = data.select(
        "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("f"),
        F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("kinds"),
    ).orderBy("treeID", "id").collect()
    out: dict[int, dict[str, list]] = {}
    for r in rows:
        if r["f"] >= 0 and r["kinds"] >= 0:
            raise TypeError("trees with splits by category cannot be explained")
        tree = out.setdefault(r["treeID"], {k: [] for k in ("feature", "threshold", "left", "right", "cover", "value")})
        stats = [float(s) for s in r["impurityStats"]]
        cover = sum(stats) if shares else stats[0]
        tree["feature"].append(r["f"])
        tree["threshold"].append(r["cut"][0] if r["f"] >= 0 else 0.0)
        tree["left"].append(r["leftChild"])
        tree["right"].append(r["rightChild"])
        tree["cover"].append(cover)
        tree["value"].append([s / cover for s in stats] if shares else [r["prediction"]])
    return [out[t] for t in sorted(out)]


def tree_model(spark: SparkSession, model: Any) -> TreeModel:
    """A TreeModel whose sums are what a fitted tree, forest or boosting of pyspark.ml predicts.

    Classifiers: class shares, the mean over a forest's trees; a boosting classifier: its margin for the second class.
    """
    if isinstance(model, TreeModel):
        return model
    inner = model.model if isinstance(model, MlModel) else None
    kind = type(inner).__name__
    if kind in ("DecisionTreeRegressionModel", "DecisionTreeClassificationModel"):
        nodes, weights = _spark_nodes(spark, inner, "Class" in kind), [1.0]
    elif kind in ("RandomForestRegressionModel", "RandomForestClassificationModel"):
        nodes = _spark_nodes(spark, inner, "Class" in kind)
        weights = [1.0 / len(nodes)] * len(nodes)
    elif kind in ("GBTRegressionModel", "GBTClassificationModel"):
        nodes, weights = _spark_nodes(spark, inner, False), [float(w) for w in inner.treeWeights]
    else:
        raise TypeError(f"no trees to explain in {kind if inner is not None else type(model).__name__}")
    return TreeModel(model.features, nodes, weights, model.labels)


def shapley(model: Any, df: DataFrame, keep: Sequence[str] = (), label: Any = None) -> DataFrame:
    """(keep, base, explained, contributions): exact Shapley values of every row, in the order of the model's features.

    `base` is the mean of the explained output over the training rows, `explained` the row's; contributions sum to their
    difference. An unknown feature's splits are passed by the shares of training rows (path-dependent values). The output
    is a regression's value or the share of the class `label` (default: the last class). A missing value goes right, as in
    training of pyspark.ml. Work per row: leaves times features on their paths; patterns of met tests are weighed once a task.
    """
    trees = tree_model(df.sparkSession, model)
    parts = [(w, t, t.paths()) for w, t in zip(trees.weights, trees.trees())]
    outputs = parts[0][1].value.shape[1] if parts else 1
    output = 0 if outputs == 1 else trees.labels.index(label) if label is not None else outputs - 1
    base = float(sum(w * t.mean()[output] for w, t, _ in parts))

    @F.pandas_udf("explained double, contributions array<double>")
    def explain(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.to_numpy(dtype=float)
        said, phi = np.zeros(len(x)), np.zeros(x.shape)
        for w, tree, paths in parts:
            said += w * tree.value[tree.leaf_of(x), output]
            phi += w * contributions(paths, x, output)
        return pd.DataFrame({"explained": said, "contributions": list(phi)})

    told = df.select(*[col(c) for c in keep], explain(_numbers(trees.features)).alias("__told"))
    return told.select(*[col(c) for c in keep], F.lit(base).alias("base"), "__told.explained", "__told.contributions")


# -- extremely random trees -------------------------------------------------------------------------


def draw(*parts: Any) -> list[float]:
    """Four uniform numbers in [0, 1) from the md5 of the parts."""
    text = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return [int(text[8 * i : 8 * i + 8], 16) / SPAN for i in range(4)]


def impurity(stats: np.ndarray, criterion: str) -> float:
    """Impurity times rows, from (rows, sum, sum of squares) of numbers or the rows of each class."""
    n = stats[0] if criterion == "variance" else stats.sum()
    if n <= 0:
        return 0.0
    if criterion == "variance":
        return max(0.0, float(stats[2] - stats[1] * stats[1] / n))
    shares = stats[stats > 0] / n
    return float(n * (1 - (shares**2).sum())) if criterion == "gini" else float(-n * (shares * np.log2(shares)).sum())


@dataclass
class _Node:
    """A node that may still be split: its number (root 1, children 2i and 2i + 1), its place in the tree, and its box."""

    number: int
    place: int
    lows: np.ndarray
    highs: np.ndarray

    def cuts(self, seed: int, tree: int, k: int) -> list[tuple[int, float]]:
        """TRIES hash-drawn cuts in the box for each of k hash-drawn features."""
        named = sorted(range(len(self.lows)), key=lambda f: draw(seed, tree, self.number, f)[0])[:k]
        out = []
        for f in named:
            low, high = float(self.lows[f]), float(self.highs[f])
            drawn = [u for part in range(-(-TRIES // 4)) for u in draw(seed, tree, self.number, f, part)]
            out += [(f, low + (high - low) * u) for u in drawn[:TRIES]]
        return out


@dataclass
class ExtraTrees:
    """Extremely random trees (Geurts et al. 2006), all grown together, one job a level.

    A node draws features, and cuts of each uniformly between the ends of its box; the first cut with `min_leaf` rows on both
    sides counts, which is a uniform draw between the least and the largest value it has. Of these cuts that with the largest
    fall of impurity splits the node. A node stays a leaf where no cut does, where the fall, weighted by its share of
    rows, is under `min_decrease`, or at `max_depth`. Draws are hashes of (seed, tree, node, feature), so trees do not
    depend on how rows are spread. With `bootstrap` a row counts in a tree as often as a Poisson draw from its content says.

    Rows never leave their partitions: a task adds up, for each node, the rows left of each cut.
    """

    n_trees: int = 100
    max_depth: int = 11
    min_leaf: int = 1
    min_split: int = 2
    min_decrease: float = 0.0
    max_features: str | float = "all"
    criterion: str = "variance"
    bootstrap: bool = False
    seed: int = 5

    def grow(self, rows: DataFrame, features: Sequence[str], label: str, classes: int | None) -> list[dict[str, list]]:
        """Node tables from complete rows of numbers; `label` is a number, or a class number below `classes`."""
        p = len(features)
        k = {"all": p, "sqrt": max(1, int(math.sqrt(p))), "log2": max(1, int(math.log2(p)))}.get(self.max_features)
        k = max(1, int(float(self.max_features) * p)) if k is None else k
        rows = rows.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], col(label).cast("double").alias("y"))
        rows = rows.withColumn("h", F.xxhash64(*rows.columns) if self.bootstrap else F.lit(0).cast("bigint")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ends = rows.agg(*[f(f"x{i}") for f in (F.min, F.max) for i in range(p)]).first()
            if ends[0] is None:
                raise ValueError("no complete row to grow trees on")
            lows, highs = np.array(ends[:p]), np.array(ends[p:])
            trees = [{"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "cover": [0.0], "value": [[0.0]]} for _ in range(self.n_trees)]
            active = {t: [_Node(1, 0, lows, highs)] for t in range(self.n_trees)}
            whole: dict[int, float] = {}
            for _ in range(self.max_depth):
                active = {t: nodes for t, nodes in active.items() if nodes}
                grown: dict[int, list[_Node]] = {}
                for part in self._slices(active, k, classes or 3):
                    cuts = {t: [n.cuts(self.seed, t, k) for n in active[t]] for t in part}
                    sums = self._sums(rows, p, classes, {t: trees[t] for t in part}, {t: [n.place for n in active[t]] for t in part}, cuts)
                    for t in part:
                        whole.setdefault(t, self._size(sums[t][0, -1]))
                        grown[t] = self._split(trees[t], active[t], cuts[t], sums[t], whole[t], classes)
                active = grown
            return trees
        finally:
            rows.unpersist()

    @staticmethod
    def _slices(active: dict[int, list[_Node]], k: int, width: int) -> Iterator[list[int]]:
        part, cells = [], 0
        for t, nodes in active.items():
            more = len(nodes) * (k * TRIES + 1) * width
            if part and cells + more > LEVEL_CELLS:
                yield part
                part, cells = [], 0
            part.append(t)
            cells += more
        if part:
            yield part

    def _size(self, stats: np.ndarray) -> float:
        return float(stats[0] if self.criterion == "variance" else stats.sum())

    def _value(self, stats: np.ndarray) -> list[float]:
        if self.criterion == "variance":
            return [float(stats[1] / stats[0]) if stats[0] else 0.0]
        return (stats / max(stats.sum(), 1.0)).tolist()

    def _sums(
        self, rows: DataFrame, p: int, classes: int | None, trees: dict[int, dict], places: dict[int, list[int]], cuts: dict[int, list]
    ) -> dict[int, np.ndarray]:
        """Per tree an array (node, cut, statistic) of the rows left of each cut; the last cut stands for all rows."""
        width = classes or 3
        made = {
            t: (Tree.of(nodes), np.array(places[t]), np.array([[f for f, _ in c] for c in cuts[t]]), np.array([[v for _, v in c] for c in cuts[t]]))
            for t, nodes in trees.items()
        }
        poisson = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
        bootstrap, seed = self.bootstrap, self.seed

        def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {t: np.zeros((len(at), f.shape[1] + 1, width)) for t, (_, at, f, _) in made.items()}
            for batch in batches:
                x, y = batch[[f"x{i}" for i in range(p)]].to_numpy(float), batch["y"].to_numpy(float)
                stats = np.eye(width)[y.astype(int)] if classes else np.stack([np.ones(len(y)), y, y * y], axis=1)
                mixed = batch["h"].to_numpy(np.int64).astype(np.uint64)
                for t, (tree, at, f, cut) in made.items():
                    slot = np.full(len(tree.feature), -1)
                    slot[at] = np.arange(len(at))
                    spot = slot[tree.leaf_of(x)]
                    use = np.flatnonzero(spot >= 0)
                    spot, given = spot[use], stats[use]
                    if bootstrap:
                        h = mixed[use] ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
                        for shift in (30, 27, 31):
                            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
                        given = given * np.searchsorted(poisson, (h >> np.uint64(11)) / float(1 << 53))[:, None]
                    below = np.take_along_axis(x[use], f[spot], axis=1) <= cut[spot]
                    below = np.concatenate([below, np.ones((len(use), 1), bool)], axis=1)
                    n = below.shape[1]
                    cell = (spot[:, None] * n + np.arange(n))[below]
                    row = np.broadcast_to(np.arange(len(use))[:, None], below.shape)[below]
                    for s in range(width):
                        sums[t][..., s] += np.bincount(cell, weights=given[row, s], minlength=len(at) * n).reshape(len(at), n)
            for t, v in sums.items():
                spot = np.flatnonzero(v.ravel())
                yield pd.DataFrame({"tree": np.full(len(spot), t), "cell": spot, "v": v.ravel()[spot]})

        found = rows.mapInPandas(level, "tree long, cell long, v double").groupBy("tree", "cell").agg(F.sum("v").alias("v")).toPandas()
        out = {t: np.zeros(len(at) * (f.shape[1] + 1) * width) for t, (_, at, f, _) in made.items()}
        for t, part in found.groupby("tree"):
            out[t][part["cell"].to_numpy()] = part["v"].to_numpy()
        return {t: out[t].reshape(len(at), f.shape[1] + 1, width) for t, (_, at, f, _) in made.items()}

    def _split(
        self, tree: dict[str, list], nodes: list[_Node], cuts: list[list[tuple[int, float]]], sums: np.ndarray, whole: float, classes: int | None
    ) -> list[_Node]:
        grown = []
        for node, drawn, stats in zip(nodes, cuts, sums):
            total = stats[-1]
            tree["cover"][node.place], tree["value"][node.place] = self._size(total), self._value(total)
            here, best = impurity(total, self.criterion), None
            if here <= 0 or self._size(total) < self.min_split:
                continue
            counted: set[int] = set()
            for (f, cut), left in zip(drawn, stats):
                right = total - left
                if f in counted or min(self._size(left), self._size(right)) < max(self.min_leaf, 1):
                    continue
                counted.add(f)
                fall = here - impurity(left, self.criterion) - impurity(right, self.criterion)
                if best is None or fall > best[0]:
                    best = (fall, f, cut, left, right)
            if best is None or best[0] <= 0 or best[0] / whole < self.min_decrease:
                continue
            _, f, cut, left, right = best
            tree["feature"][node.place], tree["threshold"][node.place] = f, cut
            for side, number, part in (("left", 2 * node.number, left), ("right", 2 * node.number + 1, right)):
                place = len(tree["feature"])
                tree[side][node.place] = place
                for name, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("cover", self._size(part)), ("value", self._value(part))):
                    tree[name].append(v)
                lows, highs = node.lows.copy(), node.highs.copy()
                (highs if side == "left" else lows)[f] = cut
                grown.append(_Node(number, place, lows, highs))
        return grown
