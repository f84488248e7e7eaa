import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.ml.candidates import classify_candidates, make_task, regress_candidates
from tabprep.ml.models import load_model, save_model
from tabprep.ml.search import dependence_data, fit_model, global_importance
from tabprep.ml.trees import TRIES, ExtraTrees, Tree, contributions, draw, impurity, shapley, tree_model

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    """200 rows of whole numbers, so that sums are exact; gaps only among rows to explain."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (200, 4))
    y = 3 * x[:, 0] + x[:, 1] * x[:, 2] // 5 + rng.integers(0, 9, 200)
    rows = [(i, *[float(v) for v in r], float(t), ["low", "mid", "top"][min(2, int(t) // 60)], int(t > 80)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double, k string, s int").repartition(3).persist()


def known_to(tree, x, known, node=0):
    """The tree's mean value over training rows if only `known` features of x are."""
    f = int(tree.feature[node])
    if f < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return known_to(tree, x, known, left if x[f] <= tree.threshold[node] else right)
    share = tree.cover[left] / tree.cover[node]
    return share * known_to(tree, x, known, left) + (1 - share) * known_to(tree, x, known, right)


def enumerated(tree, x, output):
    """Shapley values by all sets of features."""
    p, out = len(x), np.zeros(len(x))
    for j in range(p):
        rest = [f for f in range(p) if f != j]
        for size in range(p):
            weight = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
            for known in itertools.combinations(rest, size):
                out[j] += weight * (known_to(tree, x, {*known, j})[output] - known_to(tree, x, set(known))[output])
    return out


def test_contributions_equal_all_sets(table):
    trees = tree_model(table.sparkSession, fit_model(table, "y", NAMES, "dtr", max_depth=6))
    tree = trees.trees()[0]
    x = np.array([[r[c] if r["id"] % 7 else math.nan for c in NAMES] for r in table.limit(40).collect()])
    got = contributions(tree.paths(), x, 0)
    assert np.allclose(got, [enumerated(tree, row, 0) for row in x])
    assert np.allclose(got.sum(axis=1), tree.value[tree.leaf_of(x), 0] - tree.mean()[0])


@pytest.mark.parametrize("name,classify,settings", [("dtr", False, {"max_depth": 4}), ("rf", False, {"n_estimators": 6, "max_depth": 4}), ("gradBoost", False, {"n_estimators": 6, "max_depth": 3}),
                                                    ("DTC", True, {"max_depth": 4}), ("rf", True, {"n_estimators": 6, "max_depth": 4}), ("extra_trees", True, {"n_estimators": 6, "max_depth": 5})])
def test_shapley_sums_to_the_prediction(table, name, classify, settings):
    """Contributions add up to what the model itself says, less the mean."""
    model = fit_model(table, "k" if classify else "y", NAMES, name, classify, **settings)
    rows = shapley(model, table, ["id", "a"], **({"label": "mid"} if classify else {})).collect()
    assert len(rows) == 200 and len({r["base"] for r in rows}) == 1
    for r in rows:
        assert math.isclose(r["base"] + sum(r["contributions"]), r["explained"], rel_tol=1e-9, abs_tol=1e-9)
    if not classify:
        said = {r["id"]: r["prediction"] for r in model.transform(table).collect()}
        assert all(math.isclose(said[r["id"]], r["explained"], rel_tol=1e-9) for r in rows)
    else:  # the class with the largest share is the one predicted
        shares = {c: {r["id"]: r["explained"] for r in shapley(model, table, ["id"], c).collect()} for c in model.labels}
        for r in model.transform(table).collect():
            assert shares[r["prediction"]][r["id"]] >= max(s[r["id"]] for s in shares.values()) - 1e-12


def test_shapley_of_other_models(table):
    with pytest.raises(TypeError):
        shapley(fit_model(table, "y", NAMES, "linreg"), table)
    margin = fit_model(table, "s", NAMES, "gbt", True, n_estimators=3, max_depth=2)
    for r in shapley(margin, margin.transform(table), ["prediction"]).collect():
        assert (r["explained"] > 0) == (r["prediction"] == 1)
    alone = tree_model(table.sparkSession, margin)
    assert [r[0] for r in alone.transform(table).select("prediction").collect()] == [r[0] for r in margin.transform(table).select("prediction").collect()]


def test_importance_and_dependence(table):
    model = fit_model(table, "y", NAMES, "rf", n_estimators=8, max_depth=5)
    found = [tuple(r) for r in global_importance(model, table, NAMES, by="shapley").collect()]
    want = np.abs([r["contributions"] for r in shapley(model, table).collect()]).mean(axis=0)
    assert found[-1][0] == "d" and all(math.isclose(dict(found)[f], w) for f, w in zip(NAMES, want))
    lines = dependence_data(model, table, NAMES, ["id"], top=2, by="shapley")
    told = {r["id"]: r["contributions"] for r in shapley(model, table, ["id"]).collect()}
    assert lines.count() == 400
    assert all(math.isclose(r["contribution"], told[r["id"]][NAMES.index(r["feature"])]) for r in lines.collect())


def grown(rows, labels, settings, tree, number, lows, highs, depth, whole):
    """One node of an extremely random tree by plain recursion: nested (feature, cut, left, right) or the rows' answers."""
    kind = settings.criterion
    stats = lambda part: np.array([len(part), sum(part), sum(v * v for v in part)]) if labels is None else np.array([part.count(c) for c in range(labels)])
    ys = [y for _, y in rows]
    here = impurity(stats(ys), kind)
    if depth == settings.max_depth or here <= 0 or len(rows) < settings.min_split:
        return sorted(ys)
    p = len(lows)
    k = {"all": p, "sqrt": max(1, int(math.sqrt(p)))}[settings.max_features]
    best = None
    for f in sorted(range(p), key=lambda f: draw(settings.seed, tree, number, f)[0])[:k]:
        for r in range(TRIES):
            cut = lows[f] + (highs[f] - lows[f]) * draw(settings.seed, tree, number, f, r // 4)[r % 4]
            left, right = [y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]
            if min(len(left), len(right)) >= max(1, settings.min_leaf):
                fall = here - impurity(stats(left), kind) - impurity(stats(right), kind)
                if best is None or fall > best[0]:
                    best = (fall, f, cut)
                break
    if best is None or best[0] <= 0 or best[0] / whole < settings.min_decrease:
        return sorted(ys)
    _, f, cut = best
    inner, outer = [list(highs), list(lows)], None
    inner[0][f], inner[1][f] = cut, cut
    sides = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
    return (f, cut, grown(sides[0], labels, settings, tree, 2 * number, lows, inner[0], depth + 1, whole),
            grown(sides[1], labels, settings, tree, 2 * number + 1, inner[1], highs, depth + 1, whole))


def shape(tree, node=0):
    if tree.feature[node] < 0:
        return None
    return (int(tree.feature[node]), float(tree.threshold[node]), shape(tree, int(tree.left[node])), shape(tree, int(tree.right[node])))


def outline(node):
    return None if isinstance(node, list) else (node[0], node[1], outline(node[2]), outline(node[3]))


@pytest.mark.parametrize("settings", [ExtraTrees(3, 4, 3, 5, 0.0, "sqrt"), ExtraTrees(2, 5, 1, 2, 0.01, "all"), ExtraTrees(3, 4, 2, 2, 0.0, "sqrt", "entropy"), ExtraTrees(2, 3, 2, 2, 0.02, "all", "gini")])
def test_trees_equal_plain_recursion(table, settings):
    classes = None if settings.criterion == "variance" else 3
    df = table.withColumn("__y", F.col("y") if classes is None else F.when(F.col("k") == "low", 0).when(F.col("k") == "mid", 1).otherwise(2))
    trees = settings.grow(df, NAMES, "__y", classes)
    rows = [([r[c] for c in NAMES], r["__y"] if classes is None else int(r["__y"])) for r in df.collect()]
    lows, highs = [list(e) for e in zip(*[(min(x[f] for x, _ in rows), max(x[f] for x, _ in rows)) for f in range(4)])]
    for t, nodes in enumerate(trees):
        assert shape(Tree.of(nodes)) == outline(grown(rows, classes, settings, t, 1, lows, highs, 0, len(rows)))


def test_one_job_a_level(table):
    """All trees share a level's job; many cells are cut into several, with the same trees."""
    import tabprep.ml.trees as module

    settings = ExtraTrees(7, 3, 2)
    calls, sums = [], ExtraTrees._sums
    try:
        ExtraTrees._sums = lambda *a: calls.append(1) or sums(*a)
        once = settings.grow(table, NAMES, "y", None)
        assert len(calls) == 3
        held, module.LEVEL_CELLS = module.LEVEL_CELLS, 400
        assert settings.grow(table, NAMES, "y", None) == once and len(calls) > 9
    finally:
        ExtraTrees._sums, module.LEVEL_CELLS = sums, held


def test_bootstrap_and_saving(table, tmp_path):
    task = make_task(table, "y", NAMES, False)
    model = regress_candidates()["extraTrees"].fit(task, {"n_estimators": 30, "max_depth": 6, "bootstrap": True})
    covers = [n["cover"][0] for n in model.nodes]
    assert len(set(covers)) > 5 and abs(np.mean(covers) - 200) < 20
    assert regress_candidates()["extraTrees"].fit(make_task(table.repartition(5), "y", NAMES, False), {"n_estimators": 30, "max_depth": 6, "bootstrap": True}).nodes == model.nodes
    save_model(table.sparkSession, model, str(tmp_path / "m"))
    again = load_model(table.sparkSession, str(tmp_path / "m"))
    gap = table.withColumn("a", F.when(F.col("id") > 3, F.col("a")))
    assert [r["prediction"] for r in again.transform(gap).orderBy("id").collect()] == [r["prediction"] for r in model.transform(gap).orderBy("id").collect()]


def test_nothing_to_grow_on(spark, table):
    with pytest.raises(ValueError):
        regress_candidates()["extraTrees"].fit(make_task(table.where("a is null"), "y", NAMES, False), {})
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, y double")
    model = regress_candidates()["extraTrees"].fit(make_task(same, "y", ["a"], False), {"n_estimators": 2})
    assert {r["prediction"] for r in model.transform(same).collect()} == {3.0}
    one = classify_candidates()["extra_trees"].fit(make_task(same, "a", ["y"], True), {"n_estimators": 2})
    assert {r["prediction"] for r in one.transform(same).collect()} == {1.0}
