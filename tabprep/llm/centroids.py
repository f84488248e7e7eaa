"""Centroid clustering of whole-number vectors by scalar look-up tables.

Vectors are written once as blocks: per dimension the whole numbers that occur in the block, and per row their places in that
list. In a round a block tabulates, for each dimension, the squared difference of every occurring number to every centroid;
a row's distances are then gathers from these tables, added up. All sums are whole numbers, so rounds are exact and do not
depend on how rows are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from ..session import pinned, scratch_path
from .base import long_id, pick, table

SCALE = 64.0
DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
BLOCK_ROWS = 1 << 13
LARGEST = 1 << 24  # distances and sums of components up to this fit 64 bits: 64 * (2 * 2^24)^2 = 2^56, 2^39 rows * 2^24 = 2^63

BLOCK = "ids array<bigint>, sizes binary, levels binary, places binary"
PART = "cluster int, n long, total array<bigint>"
FOUND = "vec_id long, cluster int, distance long"


@dataclass(frozen=True)
class Block:
    """`levels` has the occurring numbers, dimension after dimension (`sizes` many each); `places` is dimensions x rows."""

    sizes: np.ndarray
    levels: np.ndarray
    places: np.ndarray

    @staticmethod
    def of(numbers: np.ndarray) -> "Block":
        found = [np.unique(numbers[:, d], return_inverse=True) for d in range(numbers.shape[1])]
        places = np.array([p for _, p in found], dtype=np.uint16).reshape(numbers.shape[1], len(numbers))
        return Block(np.array([len(v) for v, _ in found], np.uint16), np.concatenate([v for v, _ in found]).astype(np.int64), places)

    @staticmethod
    def read(sizes: bytes, levels: bytes, places: bytes) -> "Block":
        sizes = np.frombuffer(sizes, "<u2")
        return Block(sizes, np.frombuffer(levels, "<i8"), np.frombuffer(places, "<u2").reshape(len(sizes), -1))

    def row(self, ids: list) -> tuple:
        return (ids, *[a.astype(t).tobytes() for a, t in ((self.sizes, "<u2"), (self.levels, "<i8"), (self.places, "<u2"))])

    def dimensions(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = 0
        for size, places in zip(self.sizes.tolist(), self.places):
            yield self.levels[start : start + size], places
            start += size

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every row; of equally near centroids the first."""
        sums = np.zeros((self.places.shape[1], len(centroids)), dtype=np.int64)
        for d, (levels, places) in enumerate(self.dimensions()):
            squares = (levels[:, None] - centroids[None, :, d]) ** 2
            sums += squares[places]
        chosen = sums.argmin(axis=1)
        return chosen, sums[np.arange(len(chosen)), chosen]

    def totals(self, chosen: np.ndarray, k: int) -> np.ndarray:
        """Sum of the rows of each cluster, from how often it has each number."""
        out = np.empty((k, len(self.sizes)), dtype=np.int64)
        for d, (levels, places) in enumerate(self.dimensions()):
            n = np.bincount(chosen * len(levels) + places, minlength=k * len(levels)).reshape(k, len(levels))
            out[:, d] = n @ levels
        return out


def usable(batch: pa.RecordBatch, scale: float, dimensions: int) -> tuple[list, np.ndarray]:
    """(ids, whole numbers) of the rows whose vectors take part."""
    vectors = batch.column(1)
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is NaN here
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(flat * scale)
        bad = ~(np.abs(flat) <= LARGEST)
    sums = np.concatenate(([0], np.cumsum(bad)))
    starts, ends = offsets[:-1], offsets[1:]
    rows = np.flatnonzero(np.asarray(vectors.is_valid()) & (ends - starts == dimensions) & (sums[ends] == sums[starts]))
    numbers = flat[starts[rows][:, None] + np.arange(dimensions)].astype(np.int64)
    return batch.column(0).take(pa.array(rows)).to_pylist(), numbers


def write_blocks(vectors: DataFrame, path: str, scale: float, dimensions: int, block_rows: int) -> DataFrame:
    """Blocks of (id, vector) rows under `path`, cut in the scan without a shuffle."""
    names = [c.split()[0] for c in BLOCK.split(", ")]
    types = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def block(n: int) -> pa.RecordBatch:
            numbers = np.concatenate(held)
            row = Block.of(numbers[:n]).row(ids[:n])
            del ids[:n]
            held[:] = [numbers[n:]]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            some, numbers = usable(batch, scale, dimensions)
            ids += some
            held.append(numbers)
            while len(ids) >= block_rows:
                yield block(block_rows)
        if ids:
            yield block(len(ids))

    vectors.mapInArrow(blocks, BLOCK).write.parquet(path)
    return vectors.sparkSession.read.schema(BLOCK).parquet(path)


def first_centroids(vectors: DataFrame, k: int, scale: float, dimensions: int) -> np.ndarray:
    """The k vectors that take part with the least sha256 of `1:<id>`; equal ids by their numbers, no id last."""
    schema = "vec_id long, numbers array<bigint>"

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = usable(batch, scale, dimensions)
            values = [pa.array(ids, pa.int64()), pa.array(list(numbers), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(values, names=["vec_id", "numbers"])

    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.mapInArrow(whole, schema).orderBy(name.asc_nulls_last(), "numbers").limit(k).collect()
    return np.array([r["numbers"] for r in chosen], dtype=np.int64).reshape(-1, dimensions)


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chosen, distance = Block.read(row["sizes"], row["levels"], row["places"]).nearest(centroids)
                columns = [pa.array(row["ids"], pa.int64()), pa.array(chosen, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, FOUND)


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: each task adds up its blocks, k rows a task reach one more aggregation."""
    k, dimensions = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row["sizes"], row["levels"], row["places"])
                chosen, _ = block.nearest(centroids)
                n += np.bincount(chosen, minlength=k)
                total += block.totals(chosen, k)
        some = np.flatnonzero(n)
        columns = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])

    sums = [F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(dimensions)]
    found = blocks.mapInArrow(run, PART).groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [r[f"d{d}"] // r["n"] for d in range(dimensions)]
    return out


def clusters(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    dimensions: int = DIMENSIONS,
    vec_id: str = "vec_id",
    embedding: str | Column = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids.

    Components become floor(scale * x). Vectors of another length than `dimensions`, null ones, and those with a null or
    non-finite component take no part; nor do those with a component beyond 2^24 after scaling, whose sums of squares would leave
    64-bit whole numbers. Of k vectors or fewer each starts a centroid. Rows without id are clustered too but start one only if
    others are too few; repeated rows count each. Equally near centroids: the smaller number. A centroid without
    vectors stays. An empty table gives no row and no centroid.

    Nothing but k rows of sums a task is shuffled; the driver holds k centroids. Blocks lie in the shared folder, so a
    lost executor's blocks are read again.
    """
    if not 0 < block_rows < 1 << 16:
        raise ValueError("places and counts of a block are 16-bit numbers: 0 < block_rows < 65536")
    spark = vectors.sparkSession
    values = col(embedding) if isinstance(embedding, str) else embedding
    rows = pick(vectors, vec_id=long_id(vec_id), embedding=values.cast("array<double>"))
    centroids = first_centroids(rows, k, scale, dimensions)
    blocks = write_blocks(rows, scratch_path(spark, "places"), scale, dimensions, block_rows)
    if len(centroids):
        for _ in range(rounds):
            centroids = _moved(blocks, centroids)
    return _assigned(blocks, centroids), centroids


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found, centroids = clusters(table(spark, folder, "embeddings"))
    found = pinned(found)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(c, s, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    of = F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, centroid_sha256 string"))  # a row a centroid
    inertia = F.lit(sum(sums.values())).cast("bigint").alias("inertia")
    return found.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")


def _round_sql(nr: int) -> str:
    return f"""
a{nr} as (select id, min(struct_pack(distance := distance, cluster := c)) as best
  from (select id, c, sum((x - y) * (x - y))::bigint as distance from v join c{nr} using (d) group by id, c) group by id),
c{nr + 1} as (select c, d, coalesce(moved, y) as y from c{nr} left join
  (select best.cluster as c, d, floor(sum(x) / count(*))::bigint as moved from a{nr} join v using (id) group by 1, 2) using (c, d)),"""


OP12_SQL = f"""
with n as (select row_number() over () as id, vec_id, embedding from embeddings
    where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
v as (select id, unnest(range(64)) as d, unnest([floor(64 * x::double)::bigint for x in embedding]) as x from n),
s as (select id, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from n qualify c < 16),
c0 as (select c, d, x as y from s join v using (id)),
{"".join(_round_sql(nr) for nr in range(ROUNDS))}
a as (select id, min(struct_pack(distance := distance, cluster := c)) as best
  from (select id, c, sum((x - y) * (x - y))::bigint as distance from v join c{ROUNDS} using (d) group by id, c) group by id),
h as (select c, sha256(string_agg(y::varchar, ',' order by d)) as centroid_sha256 from c{ROUNDS} group by c)
select vec_id, best.cluster::integer as cluster, best.distance as distance,
  (sum(best.distance) over (partition by best.cluster))::bigint as cluster_inertia, (sum(best.distance) over ())::bigint as inertia, centroid_sha256
from a join n using (id) join h on h.c = best.cluster
"""
