import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tabprep.functions.gram as gram
from tabprep.functions.gram import covariance, gram_matrix, pairwise_correlation, top_components
from tabprep.operators.collinear import components, pca
from tabprep.operators.correlate import corr_pearson, corr_spearman


def wide(spark, x):
    """An array of numbers as a table of columns; NaN is a gap, null in odd columns."""
    made = pd.DataFrame(x, columns=[f"c{i}" for i in range(x.shape[1])])
    gaps = [c for c in made if made[c].isna().any()]
    rows = spark.createDataFrame(made).repartition(5)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in gaps[1::2]}) if gaps else rows


def test_two_thousand_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-9, 9, (40, 2000)).astype(float)
    df = wide(spark, x)
    assert (gram_matrix(df, df.columns) == x.T @ x).all()


def test_blocks_and_slices(spark, monkeypatch):
    """Blocks of seven columns, three a pass: the same sums, gaps left out, on tasks without rows too."""
    monkeypatch.setattr(gram, "BLOCK", 7)
    monkeypatch.setattr(gram, "HELD_BLOCKS", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 30)) + 3
    x[3, 5] = x[9, 0] = np.nan
    whole = x[~np.isnan(x).any(axis=1)]
    df = wide(spark, x).repartition(12)
    assert np.allclose(gram_matrix(df, df.columns), whole.T @ whole, rtol=1e-12)
    n, means, cov = covariance(df, df.columns)
    assert n == 58 and np.allclose(means, whole.mean(0)) and np.allclose(cov, np.cov(whole.T, bias=True))
    none = df.where("c0 is null")
    assert covariance(none, df.columns)[0] == 0 and not gram_matrix(none, df.columns).any()


def test_pairwise_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 30)) * rng.uniform(0.1, 1e4, 30) + rng.uniform(-1e5, 1e5, 30)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[1:, 8] = 5.0, np.nan  # constant, hardly present
    df = wide(spark, x)
    found = {(r["a"], r["b"]): r["corr"] for r in corr_pearson(df, df.columns).collect()}
    assert len(found) == 435
    for i in range(30):
        for j in range(i + 1, 30):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            got = found[f"c{i}", f"c{j}"]
            if {i, j} & {7, 8}:
                assert got is None
            else:
                assert abs(got - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    few = {(r["a"], r["b"]): r["corr"] for r in corr_pearson(df, df.columns[:6]).collect()}
    assert all(abs(found[k] - v) < 1e-9 for k, v in few.items())
    assert np.isnan(pairwise_correlation(df, df.columns)[7, 1])


def test_spearman_of_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (90, 40)).astype(float)
    x[:, 1] = -x[:, 0]
    x[:, 2] = 3.0
    x[5, 9] = np.nan
    df = wide(spark, x)
    whole = x[~np.isnan(x).any(axis=1)]
    ranks = np.array([[(np.sum(c < v) + (np.sum(c == v) + 1) / 2) for v in c] for c in whole.T])
    found = corr_spearman(df, df.columns).collect()
    assert len(found) == 780
    for r in found:
        i, j = int(r["a"][1:]), int(r["b"][1:])
        if 2 in (i, j):
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - np.corrcoef(ranks[i], ranks[j])[0, 1]) < 1e-12


@pytest.mark.parametrize("k", [1, 4])
def test_range_finder_equals_dense(spark, k):
    """Twelve directions in 300 columns and faint noise: leading components to 1e-8."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 12)) * np.geomspace(30, 1, 12) @ np.linalg.qr(rng.normal(size=(300, 12)))[0].T + 0.01 * rng.normal(size=(150, 300)) + 2
    df = wide(spark, x)
    means, values, loadings = top_components(df, df.columns, k)
    want_values, want = components(np.cov(x.T, bias=True), k)
    assert np.allclose(means, x.mean(0)) and np.allclose(values, want_values, rtol=1e-8) and np.abs(loadings - want).max() < 1e-8


def test_pca_without_the_square(spark, monkeypatch):
    import tabprep.operators.collinear as collinear

    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 6)) * [9, 5, 3, 1, 1, 1]
    df = wide(spark, x)
    dense = np.array(sorted(map(tuple, pca(df, 2).collect())))
    monkeypatch.setattr(collinear, "DRIVER_COLUMNS", 3)
    assert np.allclose(np.array(sorted(map(tuple, pca(df, 2).collect()))), dense, atol=1e-7)
    monkeypatch.setattr(gram, "DRIVER_COLUMNS", 3)
    with pytest.raises(ValueError):
        gram.cross_products(gram.packed(df, df.columns), 6, lambda z: z, 6)
