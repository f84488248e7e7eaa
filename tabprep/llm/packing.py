"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

Documents longer than a sequence fill whole sequences first. What is left of each document is dealt in batches of BATCH
pieces; a batch of T ids is split into k = ceil(T / capacity) windows of near-equal sums. If the fullest window is above
capacity, k rises and the batch is split again. Batches do not depend on each other, so nothing is shuffled, and each task
wastes at most part of its last few windows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import filled, long_id, pick, stream, table
from .tokens import word_encoder

CAPACITY = 2048
BATCH = 512
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(window of each size, largest sum) of the k-way largest-differencing method.

    A partial partition is a list of at most k sums in descending order. The two with the widest spread are merged so that
    the largest sum of one meets the smallest of the other, until one is left. Ties go to the earlier partition. Sizes are
    above zero. Sums are held negative, for bisection, and those that are still zero not at all: most merges bring a single
    piece, which goes to its place without a sort.
    """
    n = len(sizes)
    parent = list(range(n))
    heap = [(-size if k > 1 else 0, i, [-size], [i]) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, sums, owner = heapq.heappop(heap)
        _, _, others, owners = heap[0]
        if len(others) == 1:
            size, piece = others[0], owners[0]
            if len(sums) == k:
                size += sums.pop()
                parent[piece] = owner[-1]
                piece = owner.pop()
            at = bisect_right(sums, size)
            sums.insert(at, size)
            owner.insert(at, piece)
        else:
            others, owners = others[::-1], owners[::-1]
            both = max(0, len(sums) + len(others) - k)
            alone = len(sums) - both
            for i, piece in enumerate(owners[:both], alone):
                sums[i] += others[i - alone]
                parent[piece] = owner[i]
            sums, owner = sums + others[both:], owner + owners[both:]
            order = sorted(range(len(sums)), key=sums.__getitem__)
            sums, owner = [sums[i] for i in order], [owner[i] for i in order]
        spread = sums[0] - sums[-1] if len(sums) == k else sums[0]
        heapq.heapreplace(heap, (spread, count, sums, owner))
        count += 1
    root = np.array(parent)
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    _, _, sums, owner = heap[0]
    window = np.zeros(n, dtype=np.int64)
    window[owner] = np.arange(len(owner))
    return window[root], -sums[0]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size, no window above capacity; no size may exceed it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, most = differencing(sizes, k)
        if most <= capacity:
            return window
        k += max(1, k // 100)


def packed(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: which ids of a document stand at which offset of which sequence, and the ids themselves.

    Every id, `end_id` after each document included, lies in exactly one piece. Null text is empty: one piece of one id.
    Rows without an id, and repeated rows, are packed like any other. An empty table gives no row. Sequence ids are
    unique: the task's number times 2^40 plus a count.
    """
    end = int(end_id).to_bytes(4, "little")

    def pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
        encoder = word_encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def batch() -> Iterator[tuple]:
            nonlocal sequence
            window = windows(np.array([r[2] for r in rest], dtype=np.int64), capacity)
            used: dict[int, int] = {}
            number: dict[int, int] = {}
            for (name, start, length, total, ids), w in zip(rest, window.tolist()):
                if w not in number:
                    number[w] = sequence
                    sequence += 1
                yield name, start, length, total, number[w], used.get(w, 0), ids
                used[w] = used.get(w, 0) + length

        for name, ids in encoder.encode_rows(rows):
            ids += end
            total = len(ids) // 4
            start = 0
            while total - start >= capacity:
                yield name, start, capacity, total, sequence, 0, ids[4 * start : 4 * (start + capacity)]
                sequence += 1
                start += capacity
            if start < total:
                rest.append((name, start, total - start, total, ids[4 * start :]))
                if len(rest) == BATCH:
                    yield from batch()
                    rest = []
        if rest:
            yield from batch()

    return stream(pick(docs, doc=long_id(doc_id), words=filled(text)), pieces, PIECE)


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pieces_digest(packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")))
