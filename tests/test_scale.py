"""Operators that must stay exact when one value fills a third of the table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.functions import quantiles
from tabprep.functions.levels import level_counts, lookup
from tabprep.operators import correlate, neighbors
from tabprep.operators.neighbors import knn_join
from tabprep.operators.rank import global_rank, hash_rank


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value and one group."""
    rng = random.Random(3)
    rows = [(i, "h" if i % 3 == 0 else rng.choice("abc"), 5.0 if i % 3 == 0 else round(rng.gauss(0, 9), 2)) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, g string, v double").repartition(6), rows


@pytest.mark.parametrize("small, points, accuracy", [(50_000, 1_000, 10_000), (200, 20, 200), (20, 10, 50)])
def test_quantiles_are_exact(hot, monkeypatch, small, points, accuracy):
    df, rows = hot
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "POINTS", points)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 3 / accuracy)
    shares = [0.0, 0.001, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    found = quantiles.exact_quantiles(df, {"v": (F.col("v"), shares)})["v"]
    assert [found[p] for p in shares] == pytest.approx(list(np.quantile([r[2] for r in rows], shares)))


def test_global_rank(hot):
    df, rows = hot
    expected = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    got = {r["id"]: r["rank0"] for r in global_rank(df, ["v"], ["id"]).collect()}
    assert got == expected
    within = {}
    for r in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        within.setdefault(r[1], []).append(r[0])
    got = {r["id"]: r["rank0"] for r in global_rank(df, [F.col("v").desc()], ["id"], by=["g"]).collect()}
    assert got == {i: n for ids in within.values() for n, i in enumerate(ids)}


def test_hash_rank_is_a_permutation_in_each_group(hot):
    df, rows = hot
    got = hash_rank(df, ["g"], ["id"], 5)
    for r in got.groupBy("g").agg(F.count("*").alias("n"), F.min("rank0").alias("a"), F.max("rank0").alias("b"), F.countDistinct("rank0").alias("d")).collect():
        assert (r["a"], r["b"], r["d"]) == (0, r["n"] - 1, r["n"])
    again = {r["id"]: r["rank0"] for r in hash_rank(df.repartition(2), ["g"], ["id"], 5).collect()}
    assert again == {r["id"]: r["rank0"] for r in got.collect()}


def test_lookup_keeps_every_row(spark, hot):
    df, rows = hot
    levels = level_counts(df, "v").withColumn("code", F.col("value") * 2)
    out = lookup(df, F.col("v"), levels, "code")
    assert out.count() == len(rows)
    assert out.where(F.col("code") != F.col("v") * 2).count() == 0
    gap = spark.createDataFrame([(1, None), (2, 5.0), (3, 1e9)], "id int, v double")
    assert {r["id"]: r["code"] for r in lookup(gap, F.col("v"), levels, "code").collect()} == {1: None, 2: 10.0, 3: None}


def brute(points, k, same=True):
    out = {}
    for a in points:
        near = sorted((float(np.hypot(a[1] - b[1], a[2] - b[2])), b[0]) for b in points if a[3] == b[3] and (a[0] != b[0] or not same))
        out[a[0]] = near[:k]
    return out


@pytest.mark.parametrize("block", [4096, 40])
def test_neighbours_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    rng = random.Random(7)
    points = [
        (i, 1.0 if i % 3 == 0 else float(rng.randrange(12)), 2.0 if i % 3 == 0 else float(rng.randrange(12)), "a" if i % 4 else "b")
        for i in range(400)
    ]
    df = spark.createDataFrame(points, "id int, x double, y double, g string").repartition(5)
    found = {}
    for r in knn_join(df, df, ["x", "y"], 4, "id", "g").collect():
        found.setdefault(r["id"], {})[r["place"]] = (r["distance"], r["neighbour"])
    assert {i: [d[p] for p in sorted(d)] for i, d in found.items()} == brute(points, 4)


def test_kendall_is_exact(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(9)), float(rng.randrange(7)), rng.random()) for _ in range(250)]
    rows = [(a, a + b, c) for a, b, c in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double")

    def tau(i, j):
        up = down = tx = ty = 0
        for m in range(len(rows)):
            for n in range(m):
                x, y = rows[m][i] - rows[n][i], rows[m][j] - rows[n][j]
                up += x * y > 0
                down += x * y < 0
                tx += x == 0
                ty += y == 0
        whole = len(rows) * (len(rows) - 1) / 2
        return (up - down) / ((whole - tx) * (whole - ty)) ** 0.5

    found = {(r["a"], r["b"]): r["corr"] for r in correlate.corr_kendall(df, ["a", "b", "c"]).collect()}
    assert found == {("a", "b"): pytest.approx(tau(0, 1)), ("a", "c"): pytest.approx(tau(0, 2)), ("b", "c"): pytest.approx(tau(1, 2))}


def test_no_row_data_on_the_driver():
    """Lineage is never cut on one machine, and whole frames are not fetched."""
    import pathlib

    package = pathlib.Path(__file__).parent.parent / "tabprep"
    for path in package.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text, path
        assert "crossJoin" not in text, path


def test_probed_neighbours_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(scale=4, size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    names = [f"x{i}" for i in range(16)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    exact, probed = (
        {(r["id"], r["neighbour"]) for r in knn_join(df, df, names, 5, "id", one_cell=100, probes=p).collect()} for p in (None, 12)
    )
    assert len(exact) == 7500 and len(exact & probed) / len(exact) >= 0.9
