"""Exact k nearest neighbours as a Spark join.

Points are cut into Voronoi cells around sampled pivots. The triangle inequality gives, per cell, a bound
on the distance of the k-th neighbour of any of its points, and so the range of distances to its own
pivot that a point of another cell must have to matter. Only those points travel; cells that are
still large are cut into blocks on both sides, and the blocks' best lists are merged. No candidate
is left out: the bounds only exclude points that cannot be among the k nearest (Lu et al. 2012).
In many dimensions they exclude little: a group whose cells would see most of it is not routed at all, but compared block by
block, and a block by one matrix product whose rounding is made good by exact distances of all pairs it leaves in doubt.

Equal points are one point: a vector that fills a third of the table is searched once, and offers
the k+1 smallest keys it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.columns import col, data_type, require, require_numeric
from ..functions.choose import mapped
from ..functions.hashing import SPAN, hash32
from ..functions.levels import HOT_SHARE
from ..session import pinned
from .layers import fit_layers, routed, with_cells

MAX_PIVOTS = 2_000  # over all groups; cells² routes must fit the driver
ONE_CELL = 2_000  # groups up to this size are searched whole
BLOCK = 4_096  # rows of either side compared in one task step; up to four times that where there are many blocks
DENSE = 0.25  # share of all pairs from which a group is compared whole instead of by cells
WIDE = 8  # features from which rows are compared by products, and answers travel without their numbers
PAIRS = 1 << 20  # distances a task holds at once
SLACK = 1e-9  # relative widening of bounds against rounding


SPOT = ["g", "x", "s"]  # a point: its group, numbers, categories


def _sides(a: pd.DataFrame, b: pd.DataFrame, mismatch: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Numbers of both, and of every category the codes of both."""
    codes = []
    for i in range(len(a["s"].iloc[0]) if mismatch else 0):
        both, _ = pd.factorize(pd.Series([v[i] for v in a["s"]] + [v[i] for v in b["s"]]))
        codes.append((both[: len(a)], both[len(a) :]))
    return np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()), codes


def _exact(ax: np.ndarray, bx: np.ndarray, codes: list[tuple[np.ndarray, np.ndarray]], mismatch: float) -> np.ndarray:
    """Squared distances of rows that numpy's broadcasting pairs: numeric part plus mismatch² per differing category."""
    out = np.zeros(np.broadcast_shapes(ax.shape[:-1], bx.shape[:-1]))
    for i in range(ax.shape[-1]):
        d = ax[..., i] - bx[..., i]
        out += d * d
    for a, b in codes:
        out += (a != b) * mismatch**2
    return out


def _squares(a: pd.DataFrame, b: pd.DataFrame, mismatch: float) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    ax, bx, codes = _sides(a, b, mismatch)
    return _exact(ax[:, None], bx[None], [(c[:, None], d[None]) for c, d in codes], mismatch)


def _best(
    ax: np.ndarray, bx: np.ndarray, codes: list[tuple[np.ndarray, np.ndarray]], mismatch: float, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, squared distance) of the k nearest rows of b to each row of a, ties to the earlier; in steps of PAIRS.

    Few features are taken one by one. Many go through a product of rows around their middle, whose rounding is below `off`:
    pairs that may be among the nearest get their exact distance. Numbers too large for that are taken one by one too.
    """
    p, cost = ax.shape[1], mismatch**2
    product = p >= WIDE and len(bx) > 0
    if product:
        middle = bx.mean(axis=0)
        a, b = ax - middle, bx - middle
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        off = 16 * (p + len(codes) + 8) * np.finfo(float).eps * ((np.sqrt(aa) + np.sqrt(bb.max())) ** 2 + len(codes) * cost)
        product = bool(np.isfinite(off).all())
    step = max(1, PAIRS // max(len(bx), 1))
    for start in range(0, len(ax), step):
        now = slice(start, start + step)
        here = [(c[now], d) for c, d in codes]
        if product:
            near = a[now] @ b.T
            near *= -2
            near += aa[now, None]
            near += bb[None]
            for c, d in here:
                near += (c[:, None] != d[None]) * cost
        else:
            near = _exact(ax[now, None], bx[None], [(c[:, None], d[None]) for c, d in here], mismatch)
        limit = np.full(len(near), np.inf)
        if len(bx) > k:
            limit = np.partition(near, k - 1, axis=1)[:, k - 1]
            limit = limit + 2 * off[now] if product else limit
        i, j = np.nonzero(near <= limit[:, None])
        d2 = _exact(ax[now][i], bx[j], [(c[i], d[j]) for c, d in here], mismatch) if product else near[i, j]
        order = np.lexsort((j, d2, i))
        i, j, d2 = i[order], j[order], d2[order]
        counts = np.bincount(i, minlength=len(near))
        kept = np.arange(len(i)) - (np.cumsum(counts) - counts)[i] < k
        yield start + i[kept], j[kept], d2[kept]


def knn_join(
    left: DataFrame,
    right: DataFrame,
    features: Sequence[str],
    k: int,
    key: str,
    by: str | None = None,
    categorical: Sequence[str] = (),
    mismatch: dict[str, float] | None = None,
    exclude_same: bool = True,
    carry: str | None = None,
    seed: int = 5,
    one_cell: int = ONE_CELL,
    probes: int | None = None,
    layered: int | None = None,
) -> DataFrame:
    """The k rows of `right` nearest to each row of `left`, in its group of `by`.

    Both sides hold `key`, unique per side. Result: left key, place (0 = nearest), distance, neighbour (the
    right key), its numbers as neighbour_x and categories as neighbour_s, and `carry`, a column of the right side
    as text. So nothing has to be looked up again by neighbour, which may be the same for very many rows.
    Distance is Euclidean; every differing category adds mismatch[group]². Ties go to the smaller key.

    Exact by default. In many dimensions the bounds rule out little and the work is rows times rows; `probes` then
    searches only that many cells around each cell, the nearest by their pivots: fast and approximate, so measure its
    recall against the exact answer on your data before use. Groups up to `one_cell` rows are searched whole.
    `layered` searches that many cells, and on until k points are in reach, of a layered index (`layers`): as approximate, but finding
    cells costs their square root, nothing is routed on the driver, and cells stay small up to 33 million points. Distances
    are exact either way; `layers.recall` measures what is found.

    Rows with a gap in a feature, category or group have no distance: on the left they get no answer, on the right they are not offered.
    """
    for side in (left, right):
        require(side, [key, *features, *categorical, *([by] if by else [])])
        require_numeric(side, features)
    if k < 1:
        raise ValueError("k must be at least 1")
    weights = {str(g): float(w) for g, w in (mismatch or {}).items()}

    def points(df: DataFrame, extra: str | None = None) -> DataFrame:
        group = col(by).cast("string") if by else F.lit("")
        whole = df.na.drop(subset=[*features, *categorical, *([by] if by else [])])
        numbers = F.array(*[col(f).cast("double") for f in features])
        texts = F.array(*[col(c).cast("string") for c in categorical]).cast("array<string>")
        more = [col(extra).cast("string").alias("extra")] if extra else []
        return whole.select(col(key).alias("key"), group.alias("g"), numbers.alias("x"), texts.alias("s"), *more)

    wanted = points(left)
    wide = len(features) >= WIDE
    same = W.partitionBy(*SPOT).orderBy("key")
    right_points = points(right, carry) if carry else points(right).withColumn("extra", F.lit(None).cast("string"))
    offered = right_points.withColumn("__rn", F.row_number().over(same)).where(F.col("__rn") <= k + 1).drop("__rn")
    # rows of both sides are known by numbers that are stored with them
    offered = offered.withColumn("at", F.monotonically_increasing_id())
    places = wanted.groupBy(*SPOT).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.monotonically_increasing_id())

    if layered is not None:
        places = pinned(places)
        layers = fit_layers(offered, seed, one_cell)
        offered = pinned(with_cells(offered.select("key", "at", *SPOT, "extra"), layers))
        found = _layered(places, offered, layers, weights, k + 1, data_type(right, key), layered, wide)
    else:
        pivots = _pivots(points(right), seed, one_cell)
        offered = pinned(_assign(offered, pivots, weights, ["key", "at", *SPOT, "extra"]))
        places = pinned(_assign(places, pivots, weights, ["place", *SPOT, "n"]))
        found = _search(places, offered, pivots, weights, k + 1, data_type(right, key), probes, wide)
    if wide:
        found = found.join(offered.select("at", F.col("x").alias("nx"), F.col("s").alias("ns"), "extra"), "at")
    near = F.struct("d", "key", F.col("nx").alias("x"), F.col("ns").alias("s"), "extra")
    best = found.groupBy("place").agg(F.sort_array(F.collect_list(near)).alias("near"))
    best = pinned(places.select("place", *SPOT).join(best, "place").drop("place"))

    # points that many rows share, at most 1/HOT_SHARE of them, are answered by broadcast
    rows = places.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(places.where(F.col("n") > rows * HOT_SHARE).select(*SPOT))
    often = wanted.join(hot, SPOT, "left_semi").join(F.broadcast(best.join(hot, SPOT, "left_semi")), SPOT)
    listed = wanted.join(hot, SPOT, "left_anti").join(best, SPOT).unionByName(often)
    near = F.filter("near", lambda s: s["key"] != F.col("key")) if exclude_same else F.col("near")
    return listed.select(F.col("key").alias(key), F.posexplode(F.slice(near, 1, k)).alias("place", "s")).select(
        col(key),
        "place",
        F.col("s.d").alias("distance"),
        F.col("s.key").alias("neighbour"),
        F.col("s.x").alias("neighbour_x"),
        F.col("s.s").alias("neighbour_s"),
        F.col("s.extra").alias("carry"),
    )


def _pivots(offered: DataFrame, seed: int, one_cell: int) -> pd.DataFrame:
    """Points of each group drawn by key hash; a bounded number reaches the driver."""
    sizes = {r["g"]: r["n"] for r in offered.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(MAX_PIVOTS + 1).collect()}
    if len(sizes) > MAX_PIVOTS:
        raise ValueError(f"more than {MAX_PIVOTS} groups: search them in parts")
    # finding a cell costs pivots, searching it costs points per cell: about 2 sqrt(n) pivots balance the two
    ideal = {g: 1.0 if n <= one_cell else 2 * n**0.5 for g, n in sizes.items()}
    shrink = min(1.0, MAX_PIVOTS / (sum(ideal.values()) or 1.0))
    share = {g: max(1, int(v * shrink)) for g, v in ideal.items()}
    # a hash threshold thins each group to about four times its share before anything is ordered
    bars = {g: min(SPAN, int((4 * share[g] + 40) / n * SPAN)) for g, n in sizes.items()}
    thinned = offered.withColumn("__h", hash32(seed, F.col("key"))).where(F.col("__h") < mapped(F.col("g"), bars))
    draw = W.partitionBy("g").orderBy("__h", "key")
    most = max(share.values(), default=1)
    drawn = thinned.withColumn("__rn", F.row_number().over(draw)).where(F.col("__rn") <= most).drop("__h").toPandas()
    missed = [offered.where(F.col("g") == g).limit(1).withColumn("__rn", F.lit(1)).toPandas() for g in set(sizes) - set(drawn["g"])]
    drawn = pd.concat([drawn, *missed])
    kept = drawn[drawn["__rn"] <= drawn["g"].map(share)].sort_values(["g", "__rn"])
    same = kept["g"] + "|" + kept["x"].map(lambda v: repr(list(v))) + "|" + kept["s"].map(lambda v: repr(list(v)))
    return kept[~same.duplicated()].drop(columns=["key", "__rn"]).reset_index(drop=True)


def _assign(
    points: DataFrame, pivots: pd.DataFrame, weights: dict[str, float], keep: Sequence[str]
) -> DataFrame:
    """Add the nearest pivot of the group (cell) and the distance to it (away)."""
    held = points.sparkSession.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = {g: part for g, part in held.value.groupby("g")}
        for batch in batches:
            for g, rows in batch.groupby("g"):
                if g not in centres:  # no points offered in this group
                    continue
                sides = _sides(rows, centres[g], weights.get(g, 0.0))
                found = list(_best(*sides, weights.get(g, 0.0), 1))
                nearest = np.concatenate([f[1] for f in found])
                yield rows.assign(
                    cell=centres[g].index.to_numpy()[nearest].astype("int32"),
                    away=np.sqrt(np.concatenate([f[2] for f in found])),
                )

    schema = T.StructType([points.schema[c] for c in keep] + [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    return points.select(*keep).mapInPandas(cells, schema)


def _routes(
    places: DataFrame, offered: DataFrame, pivots: pd.DataFrame, weights: dict[str, float], k: int, probes: int | None
) -> tuple[pd.DataFrame, dict[str, tuple[int, int]]]:
    """(which offered points each cell of places must see: (cell, target, low, high) on their distance to their own pivot,
    places and offered points of each group in which bounds rule out too little, and which is not routed)."""
    ask = places.groupBy("cell").agg(F.max("away").alias("reach"), F.count(F.lit(1)).alias("n")).toPandas()
    first = W.partitionBy("cell").orderBy("away")
    ranked = offered.select("cell", "away").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k)
    close = ranked.groupBy("cell").agg(F.sort_array(F.collect_list("away")).alias("close"))
    size = offered.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max("away").alias("far"))
    give = size.join(close, "cell").toPandas()
    out, whole = [], {}
    load = ask.set_index("cell")["n"]
    for g, centres in pivots.groupby("g"):
        own = []
        a = ask[ask["cell"].isin(centres.index)]
        b = give[give["cell"].isin(centres.index)]
        if a.empty or b.empty:
            continue
        gap = np.sqrt(_squares(pivots.loc[a["cell"]], pivots.loc[b["cell"]], weights.get(g, 0.0)))
        close_len = b["close"].map(len).to_numpy()
        flat = np.concatenate([np.asarray(c, float) for c in b["close"]])
        far, m, cells = b["far"].to_numpy(), b["m"].to_numpy(), b["cell"].to_numpy()
        for i, (target, reach) in enumerate(zip(a["cell"], a["reach"])):
            bounds = reach + np.repeat(gap[i], close_len) + flat
            theta = np.partition(bounds, k - 1)[k - 1] if len(bounds) > k - 1 else np.inf
            theta = theta * (1 + SLACK) + SLACK
            low, high = gap[i] - reach - theta, gap[i] + reach + theta
            sent = low <= far
            if probes is not None:
                sent &= gap[i] <= np.partition(gap[i], min(probes, len(gap[i])) - 1)[min(probes, len(gap[i])) - 1]
            own.append(pd.DataFrame({"cell": cells[sent], "target": target, "low": low[sent], "high": high[sent], "m": m[sent]}))
        asked, given = int(a["n"].sum()), int(m.sum())
        pairs = sum(int(o["m"].sum()) * int(load[o["target"].iloc[0]]) for o in own if len(o))
        if probes is None and asked > BLOCK and pairs > DENSE * asked * given:
            whole[g] = (asked, given)
        else:
            out += own
    columns = ["cell", "target", "low", "high", "m"]
    routes = pd.concat(out) if out else pd.DataFrame(columns=columns)
    routes["asks"] = routes["target"].map(load)
    return routes, whole


def _search(
    places: DataFrame,
    offered: DataFrame,
    pivots: pd.DataFrame,
    weights: dict[str, float],
    k: int,
    key_type: T.DataType,
    probes: int | None,
    wide: bool,
) -> DataFrame:
    """(place, key, at, d, …): the k nearest offered points of each place."""
    spark = places.sparkSession
    routes, whole = _routes(places, offered, pivots, weights, k, probes)
    paths = spark.createDataFrame(
        routes[["cell", "target", "low", "high"]].astype({"cell": "int32", "target": "int32", "low": float, "high": float}),
        "cell int, target int, low double, high double",
    )
    sent = offered.join(paths, "cell").where((F.col("away") >= F.col("low") * (1 - SLACK) - SLACK) & (F.col("away") <= F.col("high")))
    loads = routes.groupby("target").agg(asks=("asks", "first"), gives=("m", "sum"))
    if (loads["gives"] > BLOCK).any():
        seen = sent.groupBy("target").agg(F.count(F.lit(1)).alias("n")).toPandas().set_index("target")["n"]
        loads["gives"] = seen.reindex(loads.index).fillna(0)
    given = [F.col("target"), "key", "at", *SPOT, "extra"]
    asks, gives = places.select(F.col("cell").alias("target"), "place", *SPOT), sent.select(*given)
    if whole:  # targets of their own, after the cells
        numbers = {g: len(pivots) + i for i, g in enumerate(sorted(whole))}
        target, every = mapped(F.col("g"), numbers), F.col("g").isin(*numbers)
        asks = places.select(F.when(every, target).otherwise(F.col("cell")).cast("int").alias("target"), "place", *SPOT)
        gives = gives.unionByName(offered.where(every).withColumn("target", target.cast("int")).select(*given))
        more = pd.DataFrame([whole[g] for g in numbers], columns=["asks", "gives"], index=pd.Index(numbers.values(), name="target"))
        loads = (pd.concat([loads, more]) if len(loads) else more).rename_axis("target")
    return _meet(asks, gives, loads, weights, k, key_type, wide)


def _layered(
    places: DataFrame,
    gives: DataFrame,
    layers: dict[str, Layers],
    weights: dict[str, float],
    k: int,
    key_type: T.DataType,
    probes: int,
    wide: bool,
) -> DataFrame:
    """As `_search`, over the cells of a layered index."""
    sizes = {r["target"]: r["n"] for r in gives.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = pinned(routed(places.select("place", *SPOT), layers, probes, k, sizes))
    loads = asks.groupBy("target").agg(F.count(F.lit(1)).alias("asks")).toPandas().set_index("target")
    loads["gives"] = [sizes.get(t, 0) for t in loads.index]
    return _meet(asks.select("target", "place", *SPOT), gives, loads, weights, k, key_type, wide, several=True)


def _blocks(rows: pd.Series) -> np.ndarray:
    """Blocks of each target's rows: every row goes to all blocks of the other side, so many rows make larger blocks."""
    rows = rows.astype(float)
    return np.maximum(1, np.ceil(rows / np.clip(rows / 32, BLOCK, 4 * BLOCK))).astype("int32")


def _meet(
    asks: DataFrame,
    gives: DataFrame,
    loads: pd.DataFrame,
    weights: dict[str, float],
    k: int,
    key_type: T.DataType,
    wide: bool,
    several: bool = False,
) -> DataFrame:
    """Places (target, place, g, x, s) meet the points of their target in blocks of both sides; `several`: a place has several targets.

    Of `wide` points an answer has the number alone, or their numbers would travel once per block.
    """
    spark = asks.sparkSession
    loads["a"], loads["b"] = _blocks(loads["asks"]), _blocks(loads["gives"])
    grid = spark.createDataFrame(loads.reset_index()[["target", "a", "b"]].astype("int32"), "target int, a int, b int")

    def block(df: DataFrame, own: str, other: str, salt) -> DataFrame:
        """Give each row one block of its own side and a copy for every block of the other side."""
        spread = df.join(F.broadcast(grid), "target")
        mine = F.pmod(salt, F.col(own))
        return (
            spread.withColumn(f"{own}_at", mine.cast("int"))
            .withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        )

    told = [] if wide else ["nx", "ns", "extra"]
    asks = block(asks, "a", "b", F.xxhash64(*SPOT)).select("target", "a_at", "b_at", "place", *SPOT)
    gives = block(gives, "b", "a", F.xxhash64("key")).select("target", "a_at", "b_at", "key", "at", *SPOT, *(["extra"] if told else []))

    def nearest(_: tuple, here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ["place", "key", "at", "d", *told]})
        there = there.sort_values("key", kind="stable").reset_index(drop=True)
        weight = weights.get(here["g"].iloc[0], 0.0)
        found = list(_best(*_sides(here, there, weight), weight, k))
        rows, at, d2 = (np.concatenate(f) for f in zip(*found))
        held = {n: there[c].to_numpy()[at] for n, c in (("nx", "x"), ("ns", "s"), ("extra", "extra")) if n in told}
        return pd.DataFrame({"place": here["place"].to_numpy()[rows], "key": there["key"].to_numpy()[at], "at": there["at"].to_numpy()[at], "d": np.sqrt(d2), **held})

    schema = T.StructType(
        [T.StructField("place", T.LongType()), T.StructField("key", key_type), T.StructField("at", T.LongType()), T.StructField("d", T.DoubleType())]
        + ([T.StructField("nx", gives.schema["x"].dataType), T.StructField("ns", gives.schema["s"].dataType), T.StructField("extra", T.StringType())] if told else [])
    )
    blocks = ["target", "a_at", "b_at"]
    found = asks.groupBy(*blocks).cogroup(gives.groupBy(*blocks)).applyInPandas(nearest, schema)
    if several or (loads["b"] > 1).any():
        order = W.partitionBy("place").orderBy("d", "key")
        found = found.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).drop("__rn")
    return found
