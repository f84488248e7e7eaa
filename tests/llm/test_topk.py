import math

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabprep.llm.topk import Block, signed_digits, sliced, top_k

from .conftest import rows

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(given, chosen, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in given if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if chosen(i):
            queries[i] = min(queries.get(i, v), v, key=lambda w: np.array(w, dtype="<i8").tobytes())
    out = []
    for q, v in queries.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@settings(deadline=None)
@given(st.integers(-(1 << 40), 1 << 40))
def test_signed_digits(value):
    digits = list(signed_digits(value))
    assert sum(d << p for p, d in digits) == value
    assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=90), st.lists(st.integers(-60, 60), min_size=3, max_size=3), st.integers(1, 12))
def test_block_search(values, query, k):
    ids = np.arange(len(values))[::-1] // 2
    block = Block(*sliced(ids, np.array(values)))
    got = sorted((-s, i) for i, s in block.search(1, query, k))
    want = sorted((-int(np.dot(v, query)), int(i)) for i, v in zip(ids, values) if i != 1)[:k]
    assert got == want


def test_search(spark):
    rng = np.random.default_rng(5)
    given = [(i, rng.choice([-1.5, -0.25, 0.0, 0.001, 0.5, 2.0], 6).tolist()) for i in range(300)]
    given += [(300 + i, given[3][1]) for i in range(8)]  # ties
    given += [(400, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [math.inf] * 6), (700, [math.nan] * 6), (None, [9.0] * 6)]
    given += [(20, [1.0] * 6), (800, [3.0, 1.0]), (801, []), (-100, [-1.0] * 6)]
    df = spark.createDataFrame(given, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("score", "cell", "chunk", "block", "query_id")})
    found = top_k(df, F.col("vec_id") % 20 == 0, 10, block_rows=64, chunk_queries=4)
    assert rows(found) == sorted(plain(given, lambda i: i % 20 == 0, 10), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], SCHEMA)
    assert rows(top_k(few, F.col("vec_id") == 0)) == [(0, 1, 1, 1024 * 512 + 2048 * 512)]
    assert rows(top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0)) == []
    assert rows(top_k(few, F.col("vec_id") > 5)) == []
