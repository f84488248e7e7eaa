import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.ml.candidates import classify_candidates, make_task, regress_candidates
from tabprep.ml.kernels import FourierMap, projection
from tabprep.ml.metrics import classification_metrics, regression_metrics
from tabprep.ml.models import load_model, save_model


@pytest.fixture(scope="module")
def rings(spark):
    """Two rings around one another: no line parts them."""
    rng = np.random.default_rng(8)
    turn, outer = rng.uniform(0, 2 * np.pi, 400), rng.random(400) < 0.35
    size = np.where(outer, 3.0, 1.0) + rng.normal(scale=0.15, size=400)
    rows = [(i, float(100 + 9 * r * np.cos(t)), float(r * np.sin(t)), "out" if o else "in", float(r * r)) for i, (t, r, o) in enumerate(zip(turn, size, outer))]
    return spark.createDataFrame(rows, "id int, a double, b double, k string, y double").repartition(3).persist()


def accuracy(df, name, **settings):
    model = classify_candidates()[name].fit(make_task(df, "k", ["a", "b"], True), settings)
    return classification_metrics(model.transform(df), "k", "prediction").first()["accuracy"], model


def test_two_rings(rings):
    line, _ = accuracy(rings, "SGDC")
    assert line < 0.8
    for name in ("svc", "gaussian_process"):
        found, model = accuracy(rings, name, C=10.0, gamma=1.0)
        assert found > 0.97
    third = rings.withColumn("k", F.when(F.col("a") > 120, "far").otherwise(F.col("k")))
    assert accuracy(third, "svc", C=10.0, gamma=1.0)[0] > 0.95


def test_cosines_approach_the_kernel(rings):
    """The error of the kernel falls with the number of cosines, about as its root."""
    x = np.array([[r["a"], r["b"]] for r in rings.limit(120).collect()])
    z = (x - x.mean(0)) / x.std(0)
    kernel = np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    errors = []
    for size in (16, 256, 2048):
        made = FourierMap(["a", "b"], x.mean(0).tolist(), (1 / x.std(0)).tolist(), 0.5, size).of(x)
        errors.append(np.abs(made @ made.T - kernel).mean())
    assert errors[0] > 2 * errors[1] > 4 * errors[2] / 2 and errors[2] < 0.02
    weights, shifts = projection(5, 3, 2000)
    assert abs(weights.mean()) < 0.05 and abs(weights.std() - 1) < 0.03 and 0 <= shifts.min() and shifts.max() < 2 * np.pi


def test_regression_and_saving(rings, tmp_path):
    task = make_task(rings, "y", ["a", "b"], False)
    model = regress_candidates()["svr"].fit(task, {"C": 5.0, "epsilon": 1.3, "gamma": 1.0})
    said = model.transform(rings)
    assert regression_metrics(said, "y", "prediction").first()["R2"] > 0.9
    save_model(rings.sparkSession, model, str(tmp_path / "m"))
    again = load_model(rings.sparkSession, str(tmp_path / "m")).transform(rings.repartition(2))
    assert sorted(r["prediction"] for r in again.collect()) == pytest.approx(sorted(r["prediction"] for r in said.collect()))


def test_gaps_and_single_classes(spark, rings):
    gap = rings.withColumn("b", F.when(F.col("id") > 20, F.col("b"))).withColumn("same", F.lit(3.0))
    task = make_task(gap, "k", ["a", "b", "same"], True)
    model = classify_candidates()["svc"].fit(task, {"n_components": 32, "max_iter": 5})
    assert model.transform(gap).where("prediction is not null").count() == 400
    one = classify_candidates()["svc"].fit(make_task(rings.where("k = 'in'"), "k", ["a", "b"], True), {"n_components": 8})
    assert {r["prediction"] for r in one.transform(rings).collect()} == {"in"}


def test_cosines_are_spread_over_partitions(spark, monkeypatch):
    """Rows of one partition, as a large row group gives them, are dealt out before they become cosines; few rows stay."""
    from tabprep.ml import kernels as module

    rows = spark.range(0, 1000, 1, 1)
    assert module.spread(rows, 256).rdd.getNumPartitions() == 1
    monkeypatch.setattr(module, "PART_BYTES", 200_000)
    out = module.spread(rows, 256)
    assert out.rdd.getNumPartitions() == 11 and max(out.rdd.glom().map(len).collect()) < 200 and out.count() == 1000
    assert module.spread(rows.limit(0), 256).count() == 0
