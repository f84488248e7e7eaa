import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tabprep.operators import neighbors as module
from tabprep.operators.neighbors import knn_join


@pytest.mark.parametrize("p, scale", [(2, 1.0), (12, 1.0), (12, 1e7), (12, 1e170)])
def test_products_leave_no_neighbour_out(p, scale, monkeypatch):
    """Many ties and a far middle: the same pairs and distances as one feature after the other."""
    monkeypatch.setattr(module, "PAIRS", 1000)
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 3, (n, p)) * scale + 3 * scale for n in (40, 300))
    codes = [(rng.integers(0, 2, 40), rng.integers(0, 2, 300))]
    rows, at, d2 = (np.concatenate(f) for f in zip(*module._best(a, b, codes, 0.5, 4)))
    with np.errstate(over="ignore"):
        want = module._exact(a[:, None], b[None], [(codes[0][0][:, None], codes[0][1][None])], 0.5)
    best = np.argsort(want, axis=1, kind="stable")[:, :4]
    assert rows.tolist() == np.repeat(np.arange(40), 4).tolist() and at.tolist() == best.ravel().tolist()
    assert d2.tolist() == np.take_along_axis(want, best, 1).ravel().tolist()


def test_many_dimensions_are_not_routed(spark, monkeypatch):
    """Every cell would see most points: the group is compared whole, in few blocks, with the right neighbours."""
    monkeypatch.setattr(module, "BLOCK", 128)
    x = np.random.default_rng(8).normal(size=(700, 16))
    names = [f"x{i}" for i in range(16)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(700), tag=[f"t{i}" for i in range(700)]))
    seen, routes = [], module._routes
    monkeypatch.setattr(module, "_routes", lambda *a: seen.append(routes(*a)) or seen[-1])
    found = knn_join(df, df, names, 3, "id", one_cell=50, carry="tag").toPandas().sort_values(["id", "place"])
    paths, whole = seen[0]
    assert whole == {"": (700, 700)} and paths.empty
    d = np.sqrt(sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(16)))
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert found["neighbour"].tolist() == best.ravel().tolist() and found["carry"].tolist() == [f"t{i}" for i in best.ravel()]
    assert found["distance"].tolist() == np.take_along_axis(d, best, 1).ravel().tolist()
    assert np.stack(found["neighbour_x"].to_numpy()).tolist() == x[best.ravel()].tolist()


def test_blocks_grow_with_rows():
    sizes = module._blocks(pd.Series([0, 1, 4096, 4097, 131_072, 600_000, 6_000_000]))
    assert sizes.tolist() == [1, 1, 1, 2, 32, 37, 367]


def test_a_batch_meets_all_pivots_within_bounds(spark):
    """10,000 rows times 2,000 pivots would be 160 MB an array; a worker holds steps of a million distances."""

    class Batches:
        """A frame of which the work of a task is taken."""

        sparkSession = spark
        schema = spark.createDataFrame([], "key long, g string, x array<double>, s array<string>").schema

        def select(self, *_):
            return self

        def mapInPandas(self, work, _):
            return work

    rng = np.random.default_rng(3)

    def points(n, p):
        return pd.DataFrame({"key": range(n), "g": "", "x": list(rng.random((n, p))), "s": [np.array([])] * n})

    for p in (1, 10):
        pivots, rows = points(2000, p), points(10_000, p)
        work = module._assign(Batches(), pivots, {}, ["key", "g", "x", "s"])
        tracemalloc.start()
        found = pd.concat(work(iter([rows])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 80 << 20
        near = np.stack(rows["x"][:50])[:, None] - np.stack(pivots["x"])[None]
        assert (found["cell"][:50] == np.square(near).sum(axis=2).argmin(axis=1)).all() and len(found) == 10_000
