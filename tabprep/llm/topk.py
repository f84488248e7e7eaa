"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to whole numbers. A block of rows is stored as bitmaps: one per component and binary digit, a bit
per row. A query's score is a sum of shifted slices, one for each signed digit of its own components; the slices are added
for all rows of a block at once by full adders on bitmaps. The sum, again bit-sliced, is searched from its most significant
slice downward, keeping the rows surely among the first k and those still tied; what is tied at the end has equal scores
and is resolved by id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import col
from ..session import scratch_path
from .base import long_id, pick, table

SCALE = 1024.0
BLOCK_ROWS = 1 << 14
CHUNK_QUERIES = 256
LARGEST = float(1 << 53)  # quantised components beyond this are refused, as doubles no longer hold whole numbers there

BLOCK = "block long, n_rows int, ids binary, lows binary, widths binary, slices binary"
QUERY = "query_id long, vector binary"
HIT = "query_id long, vec_id long, score long"


def quantised(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whole components) of the rows that take part; shorter vectors are filled with 0."""
    vectors = batch.column(1)
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values
    numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(numbers)  # null is NaN here
    sums = np.concatenate(([0], np.cumsum(bad)))
    valid = np.asarray(vectors.is_valid()) & np.asarray(batch.column(0).is_valid()) & (sums[offsets[1:]] == sums[offsets[:-1]])
    rows = np.flatnonzero(valid)
    sizes = (offsets[1:] - offsets[:-1])[rows]
    out = np.zeros((len(rows), int(sizes.max(initial=0))), dtype=np.int64)
    ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[rows]
    if out.size:
        inside = np.arange(out.shape[1]) < sizes[:, None]
        taken = np.floor(scale * numbers[(offsets[:-1][rows][:, None] + np.arange(out.shape[1]))[inside]])
        if np.abs(taken).max(initial=0) > LARGEST:
            raise ValueError("a component is too large to be quantised")
        out[inside] = taken.astype(np.int64)
    return ids, out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def sliced(ids: np.ndarray, values: np.ndarray) -> tuple[int, bytes, bytes, bytes, bytes]:
    """Rows by ascending id; per component its smallest value and as many slices as the rest needs."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    n, dims = values.shape
    lows = values.min(axis=0) if n else np.zeros(dims, dtype=np.int64)
    rest = (values - lows).astype(np.uint64)
    widths = np.array([int(m).bit_length() for m in rest.max(axis=0)] if n else [0] * dims, dtype=np.uint8)
    padded = -(-n // 64) * 64
    planes = []
    for d in range(dims):
        for b in range(int(widths[d])):
            bits = np.zeros(padded, dtype=np.uint8)
            bits[:n] = rest[:, d] >> np.uint64(b) & np.uint64(1)
            planes.append(np.packbits(bits, bitorder="little").tobytes())
    return n, ids.astype("<i8").tobytes(), lows.astype("<i8").tobytes(), widths.tobytes(), b"".join(planes)


def signed_digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, +1 or -1) of the form without two digits in a row: a third of the places on average."""
    place = 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            yield place, digit
            value -= digit
        value >>= 1
        place += 1


class Block:
    def __init__(self, n_rows: int, ids: bytes, lows: bytes, widths: bytes, slices: bytes) -> None:
        self.n = n_rows
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.lows = [int(x) for x in np.frombuffer(lows, dtype="<i8")]
        self.widths = [int(x) for x in np.frombuffer(widths, dtype=np.uint8)]
        words = -(-n_rows // 64)
        self.planes = np.frombuffer(slices, dtype="<u8").reshape(-1, words) if words else np.zeros((0, 0), dtype="<u8")
        self.first = np.concatenate(([0], np.cumsum(self.widths))).tolist()
        rows = np.zeros(words * 64, dtype=np.uint8)
        rows[:n_rows] = 1
        self.rows = np.packbits(rows, bitorder="little").view("<u8")

    def added(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """(slices of the score less a constant, from the least significant; the constant)."""
        columns: dict[int, list[int]] = defaultdict(list)  # place -> slices to add, negative: complemented
        constant = 0
        for d, weight in enumerate(query[: len(self.widths)]):
            constant += weight * self.lows[d]
            for place, digit in signed_digits(weight):
                if digit < 0:  # -x = complement of x - (2^width - 1)
                    constant -= ((1 << self.widths[d]) - 1) << place
                for b in range(self.widths[d]):
                    columns[place + b].append((self.first[d] + b) * 2 + (digit < 0))
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        place = 0
        while carried or any(p >= place for p in columns):
            wanted = np.array(columns.get(place, []), dtype=np.int64)
            flips = np.where(wanted & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
            stack = np.concatenate([self.planes[wanted >> 1] ^ flips[:, None], *carried])
            carried = []
            while len(stack) > 2:  # full adders, as many at once as there are threes
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * n :]])
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros_like(self.rows))
            place += 1
        return out, constant

    def search(self, name: int, query: list[int], k: int) -> Iterator[tuple[int, int]]:
        """(id, score) of the k best rows, ties to the smaller id; rows of the query's own id take no part."""
        slices, constant = self.added(query)
        own = slice(*np.searchsorted(self.ids, [name, name + 1]).tolist())
        tied = self.rows.copy()
        for row in range(own.start, own.stop):
            tied[row // 64] &= ~np.uint64(1 << row % 64)
        sure = np.zeros_like(tied)
        left = k
        if int(np.bitwise_count(tied).sum()) <= k:
            sure, tied, left = tied, sure, 0
        for plane in reversed(slices):
            if not left:
                break
            high = tied & plane
            n = int(np.bitwise_count(high).sum())
            if n > left:
                tied = high
            else:
                sure |= high
                tied &= ~plane
                left -= n
        chosen = bits(sure) + (bits(tied)[:left] if left else [])
        for row in chosen:
            score = sum((int(p[row // 64]) >> row % 64 & 1) << i for i, p in enumerate(slices))
            yield int(self.ids[row]), score + constant


def bits(plane: np.ndarray) -> list[int]:
    return np.flatnonzero(np.unpackbits(plane.view(np.uint8), bitorder="little")).tolist()


def build_index(vectors: DataFrame, path: str, scale: float = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write the index of (id, vector) rows under `path`: every task cuts its rows into blocks, nothing is shuffled."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0

        def block(a: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            row = (number, *sliced(a, v))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            a, v = quantised(batch, scale)
            ids.append(a)
            values.append(v)
            held += len(a)
            while held >= block_rows:
                a, v = np.concatenate(ids), stacked(values)
                yield block(a[:block_rows], v[:block_rows])
                number += 1
                ids, values = [a[block_rows:]], [v[block_rows:]]
                held -= block_rows
        if held:
            yield block(np.concatenate(ids), stacked(values))

    names = [c.split()[0] for c in BLOCK.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    vectors.mapInArrow(blocks, BLOCK).write.parquet(path)
    return vectors.sparkSession.read.schema(BLOCK).parquet(path)


def query_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """Quantised vectors; of rows with the same id one is the query, that with the smallest bytes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = quantised(batch, scale)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([v.astype("<i8").tobytes() for v in values], pa.binary())], names=["query_id", "vector"]
            )

    return vectors.mapInArrow(rows, QUERY).groupBy("query_id").agg(F.min("vector").alias("vector"))


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    scale: float = SCALE,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """query_id, rank from 1, vec_id, score: for each row that fulfils `queries`, its k best other rows, all if fewer.

    `queries` is a condition on the column `vec_id` of (vec_id, embedding). Rows without an id, without a vector, or with a null or non-finite
    component take no part. Vectors of different lengths are compared as if filled with 0. Repeated rows are candidates
    each; rows that share an id do not find each other. An empty table gives no row.

    Blocks and chunks of queries meet once each: blocks are copied to every chunk and queries to every block's cell, so a
    task holds a few blocks and `chunk_queries` queries at a time, and returns k rows a query and block.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=long_id(vec_id), embedding=col(embedding).cast("array<double>"))
    index = build_index(rows, scratch_path(spark, "slices"), scale, block_rows)
    cells = max(1, index.count())
    asked = query_vectors(rows.where(queries), scale)
    chunks = max(1, -(-rows.where(queries).count() // chunk_queries))
    left = index.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>"))
    )
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks))).withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>"))
    )

    def meet(blocks: pa.Table, chunk: pa.Table) -> pa.Table:
        found: list[tuple] = []
        names = chunk.column("query_id").to_pylist()
        weights = [np.frombuffer(v, dtype="<i8").tolist() for v in chunk.column("vector").to_pylist()]
        for row in zip(*[blocks.column(c).to_pylist() for c in ("n_rows", "ids", "lows", "widths", "slices")]):
            block = Block(*row)
            for name, query in zip(names, weights):
                found += [(name, *hit) for hit in block.search(name, query, k)]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), columns)})

    hits = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(meet, HIT)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
with v as (select vec_id, [floor(1024 * x::double)::bigint for x in embedding] as e from embeddings
    where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::bigint as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
