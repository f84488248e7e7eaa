import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabprep.llm import minhash
from tabprep.llm.graph import components
from tabprep.llm.minhash import near_duplicates
from tabprep.llm.shingles import band_keys, mixed, shingle_set, similar, super_minhash

from .conftest import clashing, hard_rows, prose, rows


def plain_shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_groups(given, size):
    """Smallest id of each component, by comparing all pairs."""
    sets = [(d, plain_shingles(t, size)) for d, t, *_ in given]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is None or b is None:
                continue
            if a == b or (x and y and 100 * len(x & y) >= 80 * len(x | y)):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(x), least[find(i)] if d is not None else None) for i, (d, x) in enumerate(sets)]


def one_by_one(elements, m):
    """The published loop: one element after the other, each with its own permutation."""
    out = [1 << 64] * m
    for e in elements.tolist():
        places = list(range(m))
        for j in range(m):
            x = int(mixed(np.array([(e + 0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64)], dtype=np.uint64))[0])
            k = j + ((x & 0xFFFFFFFF) * (m - j) >> 32)
            places[j], places[k] = places[k], places[j]
            out[places[j]] = min(out[places[j]], (j << 32) | (x >> 32))
    return out


def test_super_minhash_is_the_published_one():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 300):
        elements = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert super_minhash(elements, 16).tolist() == one_by_one(elements, 16)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (80, 10, 10))
        x, y = super_minhash(np.concatenate([common, a]), 128), super_minhash(np.concatenate([common, b]), 128)
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04
    assert len(set(band_keys(x, 32).tolist())) == 32


@settings(deadline=None, max_examples=80)
@given(st.lists(st.sampled_from("a B b c é \t\n".split(" ")), max_size=30), st.integers(2, 5))
def test_shingle_set(words, size):
    text = " ".join(words)
    assert len(shingle_set(text.encode(), size)) == len(plain_shingles(text, size))


@settings(deadline=None, max_examples=80)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_similar(a, b):
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    assert similar(x, y, 80) == (100 * len(a & b) >= 80 * len(a | b))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    found = dict(rows(components(spark.createDataFrame(edges, "u bigint, v bigint"))))
    assert {x: found.get(x, x) for x in root} == {x: find(x) for x in root}
    assert rows(components(spark.createDataFrame([], "u bigint, v bigint"))) == []


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(1000)}" if rng.random() < share else w for w in text.split())


def corpus():
    """A hot copy, a hot family of near copies, chains, and texts that share a passage only."""
    passage = prose(50, 60)
    given = [(i, prose(0, 80)) for i in range(0, 60)]
    given += [(100 + i, edited(prose(1, 150), 0.02 + 0.0006 * i, i)) for i in range(90)]
    step = prose(2, 200).split()
    for i in range(12):
        given.append((300 + i, " ".join(step)))
        step[i * 15 : i * 15 + 5] = [f"new{i}{k}" for k in range(5)]
    given += [(400 + i, f"{passage} {prose(60 + i, 60)}") for i in range(40)]
    given += [(500 + i, prose(200 + i, 5 + i)) for i in range(30)]
    return given


def check(df, given, size):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=size).collect()), key=str)
    assert found == sorted(((d, n, c, d == c) for d, n, c in plain_groups(given, size)), key=str)
    return found


def test_groups(spark):
    given = corpus()
    df = spark.createDataFrame(given, "doc_id bigint, text string").repartition(5)
    found = check(df, given, 4)
    assert len({c for _, _, c, _ in found}) < len(given) - 60


def test_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HEAVY", 100)
    given = corpus()
    check(spark.createDataFrame(given, "doc_id bigint, text string").repartition(3), given, 5)


def test_hard_rows(spark, hard):
    check(clashing(hard), hard_rows(), 4)


def test_empty_tables(spark, none):
    assert rows(near_duplicates(none)) == []
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id bigint, text string")
    assert rows(near_duplicates(blank), "doc_id", "n_shingles", "component_id", "kept") == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_no_pair_lists(spark):
    """A family's links stay a forest."""
    given = [(i, edited(prose(1, 150), 0.01, i)) for i in range(200)]
    seen = defaultdict(int)
    original = minhash.components

    def counted(edges):
        edges = edges.persist()
        seen["most"] = max(seen["most"], edges.count())
        return original(edges)

    minhash.components = counted
    try:
        near_duplicates(spark.createDataFrame(given, "doc_id bigint, text string")).agg(F.count("*")).collect()
    finally:
        minhash.components = original
    assert seen["most"] < 32 * 200


def test_repeated_rows_meet_once(spark):
    """Rows that repeat id and text bring one set; an id with two texts brings both."""
    one, two = prose(5, 150), prose(6, 150)
    given = [(7, one)] * 15_000 + [(8, one + " more"), (7, two), (9, two + " more"), (10, prose(11, 150))]
    found = near_duplicates(spark.createDataFrame(given, "doc_id bigint, text string").repartition(4))
    assert {tuple(r) for r in found.select("doc_id", "component_id", "kept").distinct().collect()} == {
        (7, 7, True), (8, 7, False), (9, 7, False), (10, 10, True)
    }
    assert found.count() == len(given)


def test_one_each():
    sets = pa.table({"rep": [1, 1, 1, 2, 1], "class": [b"a", b"a", b"b", b"a", b"a"], "n": [3, 3, 4, 3, 3]})
    assert minhash.one_each(sets).to_pylist() == [sets.to_pylist()[i] for i in (0, 2, 3)]
