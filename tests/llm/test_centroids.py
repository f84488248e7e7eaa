import hashlib
import math

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabprep.llm.centroids import LARGEST, Block, clusters

from .conftest import clashing, rows

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(given, k, rounds, scale, dimensions):
    """Lloyd's rounds on Python's whole numbers."""
    kept = []
    for name, vector in given:
        if vector is None or len(vector) != dimensions or any(x is None or not math.isfinite(x) for x in vector):
            continue
        numbers = [math.floor(scale * x) for x in vector]
        if all(abs(x) <= LARGEST for x in numbers):
            kept.append((name, numbers))
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            of = [v for (_, v), c in zip(kept, found) if c == i]
            if of:
                centroids[i] = [sum(column) // len(of) for column in zip(*of)]
    return [(name, c, d) for (name, v) in kept for d, c in [nearest(v)]], centroids


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=60), st.integers(1, 5))
def test_block(numbers, k):
    numbers = np.array(numbers)
    block = Block.read(*Block.of(numbers).row([])[1:])
    centroids = np.arange(3 * k).reshape(k, 3) - 4
    chosen, distance = block.nearest(centroids)
    far = ((numbers[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert chosen.tolist() == far.argmin(axis=1).tolist() and distance.tolist() == far.min(axis=1).tolist()
    assert block.totals(chosen, k).tolist() == [numbers[chosen == c].sum(axis=0).tolist() for c in range(k)]


def test_clusters(spark):
    rng = np.random.default_rng(2)
    given = [(i, rng.choice([-1.5, -0.26, 0.0, 0.1, 3.0], 4).tolist()) for i in range(200)]
    given += [(3, given[3][1])] * 40 + [(300 + i, given[5][1]) for i in range(30)]  # repeated rows, equal vectors
    given += [(None, [9.0, 9.0, 9.0, 9.0]), (400, None), (401, []), (402, [1.0] * 3), (403, [1.0, None, 1.0, 1.0]), (404, [math.nan] * 4), (405, [math.inf] * 4)]
    given += [(406, [1e300, 0.0, 0.0, 0.0]), (407, [-1e20] * 4), (408, [LARGEST / 64.0] * 4), (409, [LARGEST / 64.0 + 1, 0.0, 0.0, 0.0])]
    df = clashing(spark.createDataFrame(given, SCHEMA)).withColumns({c: F.lit("x") for c in ("cluster", "distance", "ids", "place")})
    for blocks in (16, 1000):
        found, centroids = clusters(df.repartition(3), 7, 3, 64.0, 4, block_rows=blocks)
        want, wanted = plain(given, 7, 3, 64.0, 4)
        assert centroids.tolist() == wanted
        assert rows(found) == ordered(want)


def test_few_and_none(spark):
    few, centroids = clusters(spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], SCHEMA), dimensions=2)
    assert len(centroids) == 2 and sorted(r["distance"] for r in few.collect()) == [0, 0]
    none, centroids = clusters(spark.createDataFrame([], SCHEMA))
    assert rows(none) == [] and centroids.shape == (0, 64)
    assert rows(clusters(spark.createDataFrame([(1, [0.5])], SCHEMA))[0]) == []
