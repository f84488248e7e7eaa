import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.functions.gram import covariance, gram_matrix
from tabprep.ml.candidates import classify_candidates, make_task, regress_candidates
from tabprep.ml.metrics import classification_metrics, eq_odds_ratio, leaderboard, regression_metrics
from tabprep.ml.models import LinearModel, NeighbourModel, bayesian_ridge, least_angle, load_model, relevance, save_model
from tabprep.ml.search import SearchResult, Ucb1, automl_search, batch_score, dependence_data, fit_model, global_importance
from tabprep.ml.split import train_test_split
from tabprep.operators.collinear import components, inflation, noncollinear
from tabprep.operators.correlate import corr_cramers_v, corr_kendall, corr_phi_k, corr_spearman
from tabprep.plans.features import fe_apply, feature_engineer
from tabprep.plans.preprocess import preprocess_pipeline
from tabprep.streaming.score import stream_score, to_parquet

QUICK = {"n_estimators": 5, "max_depth": 3, "max_iter": 5}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] - x[:, 1] + 1 + rng.normal(scale=0.05, size=300)
    rows = [(i, float(a), float(b), float(v), "yes" if v > 1 else "no", i % 2) for i, ((a, b), v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, y double, c string, s int")


@pytest.mark.parametrize("name", sorted(regress_candidates()))
def test_regressors_learn(points, name):
    task = make_task(points, "y", ["a", "b"], False)
    model = regress_candidates()[name].fit(task, {**QUICK, "alpha": 0.01})
    assert regression_metrics(model.transform(points), "y", "prediction").first()["R2"] > 0.6


@pytest.mark.parametrize("name", sorted(classify_candidates()))
def test_classifiers_learn(points, name):
    task = make_task(points, "c", ["a", "b"], True)
    model = classify_candidates()[name].fit(task, {**QUICK, "max_iter": 30})
    assert classification_metrics(model.transform(points), "c", "prediction").first()["accuracy"] > 0.8


def test_search(points, tmp_path):
    result = automl_search(points.drop("s", "c"), "y", "RMSE", 5, key=["id"], families=["linreg", "dtr", "bayesian_ridge"])
    board = result.leaderboard.collect()
    assert len(board) == 5 and result.leaderboard.columns[:2] == ["name", "RMSE"]
    assert [r["RMSE"] for r in board] == sorted(r["RMSE"] for r in board)
    assert isinstance(result.best(), LinearModel)
    result.save(points.sparkSession, str(tmp_path / "search"))
    again = SearchResult.load(points.sparkSession, str(tmp_path / "search"))
    assert again.leaderboard.collect() == board and again.best() == result.best() and set(again.models) == set(result.models)
    with pytest.raises(ValueError):
        automl_search(points, "c", "parity_diff", 1)
    with pytest.raises(ValueError):
        automl_search(points, "c", "other", 1)


def test_fair_search(points):
    df = points.select("id", "a", "b", "s", F.when(F.col("c") == "yes", 1).otherwise(0).alias("c"))
    result = automl_search(df, "c", "DPD", 2, bias=True, bias_column="s", key=["id"], families=["DTC", "linear_discriminant"])
    gaps = [r["parity_diff"] for r in result.leaderboard.collect()]
    assert gaps == sorted(gaps)


def test_ucb_tries_every_arm_then_prefers_the_best():
    chooser = Ucb1(["a", "b"])
    for _ in range(40):
        arm = chooser.select()
        chooser.record(arm, 0.9 if arm == "b" else 0.1)
    assert len(chooser.scores["b"]) > len(chooser.scores["a"]) > 0


def test_metrics_at_the_edges(spark):
    one = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert regression_metrics(one, "y", "p").first()["R2"] == 1.0
    negative = spark.createDataFrame([(-1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert regression_metrics(negative, "y", "p").first()["MSLE"] is None
    none = spark.createDataFrame([("a", 1, 0, "m"), ("b", 0, 0, "f")], "k string, y int, p int, s string")
    assert eq_odds_ratio(none, "y", "p", "s").first()[0] == 0.0
    wrong = spark.createDataFrame([("a", "b"), ("a", "c")], "y string, p string")
    assert list(classification_metrics(wrong, "y", "p").first()) == [0.0, 0.0, 0.0, 0.0]


def test_leaderboard_direction(spark):
    trials = spark.createDataFrame([("m", 0.2, 1.0, 1), ("n", 0.1, 2.0, 2)], "name string, RMSE double, R2 double, run_id int")
    assert leaderboard(trials, "RMSE").first()["name"] == "n"
    assert leaderboard(trials, "R2").first()["name"] == "n"


def test_split_is_stable(points):
    train, test = train_test_split(points, 0.2, ["id"])
    assert train.count() + test.count() == 300 and 30 < test.count() < 90
    again = train_test_split(points.repartition(7), 0.2, ["id"])[1]
    assert {r["id"] for r in again.collect()} == {r["id"] for r in test.collect()}


def test_wide_cross_products_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 30)) + 5
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    assert np.allclose(gram_matrix(df, names), x.T @ x)
    assert np.allclose(gram_matrix(df, names[:4]), x[:, :4].T @ x[:, :4])
    for p in (4, 30):
        n, means, cov = covariance(df, names[:p])
        assert n == 50 and np.allclose(means, x[:, :p].mean(0)) and np.allclose(cov, np.cov(x[:, :p].T, bias=True))


def test_inflation_and_components():
    gram = np.array([[4.0, 2, 0], [2, 3, 0], [0, 0, 5.0]])
    assert np.allclose(inflation(gram), np.diag(gram) * np.diag(np.linalg.inv(gram)))
    twins = np.array([[1.0, 1, 0], [1, 1, 0], [0, 0, 1]])
    assert [n for n, _ in noncollinear(twins, ["a", "b", "c"], 5.0)] == ["b", "c"]
    _, loadings = components(np.diag([1.0, 9.0]), 1)
    assert np.allclose(loadings, [[0, 1]])


def test_bayesian_ridge_finds_the_line():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + rng.normal(scale=0.1, size=200)
    beta = bayesian_ridge(x.T @ x, x.T @ y, float(y @ y), 200, 1e-6, 1e-6, 1e-6, 1e-6)
    assert np.allclose(beta, [2, -1], atol=0.05)


def test_explanations(points):
    linear = fit_model(points, "y", ["a", "b"], "linreg")
    assert [r["feature"] for r in global_importance(linear, points, ["a", "b"]).collect()] == ["a", "b"]
    tree = fit_model(points, "y", ["a", "b"], "dtr", max_depth=5)
    assert [r["feature"] for r in global_importance(tree, points, ["a", "b"], 1, target="y", key=["id"]).collect()] == ["a"]
    data = dependence_data(tree, points, ["a", "b"], ["id"], target="y", key=["id"])
    assert data.count() == 600 and data.where("feature = 'a' and other = 'b'").count() == 300


def test_feature_request(spark):
    rows = [(float(i), float(2 * i + i % 3), float(i % 5), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    out, chain = feature_engineer(df, {"polynomial_Features": {"feature_degree": [{"feature": "c", "degree": 2}]}, "multiCollinearity": {"vif_Value": 6}})
    assert out.columns[-1] == "y" and len(out.columns) < 5
    assert fe_apply(df.drop("y"), chain.to_json()).columns == out.columns[:-1]
    parts, _ = feature_engineer(df, {"PCA": {"n_Components": 2}})
    assert parts.columns == ["0", "1", "y"]
    assert abs(parts.agg(F.avg("0")).first()[0]) < 1e-9
    for bad in ({"DateTime": {"feature": "a"}, "PCA": {"n_Components": 1}}, {"multiCollinearity": {"vif_Value": ""}}, {"Other": {}}):
        with pytest.raises(ValueError):
            feature_engineer(df, bad)


def test_stream_equals_batch(spark, points, tmp_path):
    steps = [preprocess_pipeline(points.select("a", "b"), {"a": [{"scale": [{"scale_method": ""}]}]})]
    model = fit_model(steps[0].transform(points), "y", ["a", "b"], "linreg")
    source = str(tmp_path / "in")
    points.select("id", "a", "b").repartition(3).write.parquet(source)
    arriving = spark.readStream.schema("id int, a double, b double").parquet(source)
    to_parquet(stream_score(arriving, steps, model), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["id"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["id"]: r["prediction"] for r in batch_score(points.select("id", "a", "b"), steps, model).collect()}
    with pytest.raises(ValueError):
        stream_score(arriving, steps, fit_model(points, "y", ["a", "b"], "knn"))


def test_collinear_twins_leave_the_free_column():
    rng = np.random.default_rng(4)
    z, a = rng.normal(size=(2, 200))
    x = np.column_stack([z, a, 2 * a])
    scores = inflation(x.T @ x)
    assert np.isfinite(scores[0]) and np.isinf(scores[1:]).all()
    assert [n for n, _ in noncollinear(x.T @ x, ["z", "a", "twin"], 5.0)] in (["z", "twin"], ["twin", "z"])
    plain = np.column_stack([z, a, a + 0.3 * z + 0.1 * rng.normal(size=200)])
    gram = plain.T @ plain
    unit = gram / np.sqrt(np.outer(np.diag(gram), np.diag(gram)))
    assert np.allclose(inflation(gram), np.diag(np.linalg.inv(unit)))


def test_labels_of_other_types(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.0)], "y int, p double")
    assert classification_metrics(df, "y", "p").first()["accuracy"] == pytest.approx(2 / 3)


def test_equal_training_rows_keep_their_votes(spark):
    rows = [(0.0, "a")] * 5 + [(0.1, "b"), (0.2, "b"), (0.3, "b"), (0.4, "b")]
    model = NeighbourModel(spark.createDataFrame(rows, "x double, y string"), ["x"], "y", 5, False, True)
    assert model.transform(spark.createDataFrame([(0.01,)], "x double")).first()["prediction"] == "a"


def test_ucb_rewards_do_not_depend_on_the_scale():
    chooser = Ucb1(["bad", "good", "fails"])
    picks = []
    for _ in range(60):
        arm = chooser.select()
        picks.append(arm)
        chooser.record(arm, None if arm == "fails" else -5000.0 if arm == "bad" else -40.0)
    assert picks.count("good") > picks.count("bad") > 0 and picks.count("good") > picks.count("fails")


def test_phi_k_takes_many_levels(spark):
    df = spark.range(4000).select(F.concat(F.lit("a"), F.col("id") % 60).alias("a"), F.concat(F.lit("b"), F.col("id") % 60).alias("b"))
    assert corr_phi_k(df, ["a", "b"]).first()["corr"] > 0.9


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (150, 6)).astype(float)
    x[:, 3] = x[:, 0] + x[:, 1]
    x[x == 0] *= rng.choice([-1.0, 1.0], (x == 0).sum())  # zeros of both signs
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    spearman = {(r["a"], r["b"]): r["corr"] for r in corr_spearman(df, names).collect()}
    kendall = {(r["a"], r["b"]): r["corr"] for r in corr_kendall(df, names).collect()}
    frame = df.toPandas() + 0.0
    for a, b in spearman:
        u, v = frame[a].to_numpy(), frame[b].to_numpy()
        assert spearman[a, b] == pytest.approx(np.corrcoef(frame[a].rank(), frame[b].rank())[0, 1], abs=1e-9)
        signs = np.sign(u[:, None] - u[None]) * np.sign(v[:, None] - v[None])
        size = np.sqrt((u[:, None] != u[None]).sum() * (v[:, None] != v[None]).sum())
        assert kendall[a, b] == pytest.approx(signs.sum() / size, abs=1e-12)
    assert len(spearman) == len(kendall) == 15
    assert corr_cramers_v(df, names).count() == 15 and corr_kendall(df.limit(0), names).where("corr is not null").isEmpty()


def test_least_angle_and_relevance():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    y = x @ np.array([2.0, 0, -1, 0, 0.5]) + rng.normal(scale=0.1, size=400)
    x, y = x - x.mean(axis=0), y - y.mean()
    gram, xy = x.T @ x / 400, x.T @ y / 400
    assert np.allclose(least_angle(gram, xy, 0.0, False, 0.0), np.linalg.solve(gram, xy), atol=1e-6)
    for alpha in (0.05, 0.3, 1.0):
        beta = least_angle(gram, xy, alpha, True, 0.0)
        slope = xy - gram @ beta  # the lasso's conditions
        assert np.all(np.abs(slope) <= alpha + 1e-6) and np.allclose(slope[beta != 0], alpha * np.sign(beta[beta != 0]), atol=1e-6)
    assert not least_angle(gram, xy, 1e9, True, 0.0).any()
    found = relevance(400 * gram, 400 * xy, float(y @ y), 400, 10_000, *[1e-6] * 4)
    assert np.allclose(found, [2, 0, -1, 0, 0.5], atol=0.05)


@pytest.mark.parametrize("name, classify", [("linreg", False), ("adaBoost", False), ("dtr", False), ("knn", False), ("ada", True), ("quadratic_discriminant", True), ("LogReg", True)])
def test_saved_models_give_the_same(spark, points, tmp_path, name, classify):
    family = (classify_candidates() if classify else regress_candidates())[name]
    model = family.fit(make_task(points, "c" if classify else "y", ["a", "b"], classify), QUICK)
    save_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert type(again) is type(model)
    want = {r["id"]: r["prediction"] for r in model.transform(points).collect()}
    assert {r["id"]: r["prediction"] for r in again.transform(points).collect()} == want


def test_ransac_ignores_outliers(spark):
    rng = np.random.default_rng(10)
    rows = [(i, float(a), float(3 * a + 1 if i % 5 else 500.0)) for i, a in enumerate(rng.normal(size=300))]
    task = make_task(spark.createDataFrame(rows, "id int, a double, y double"), "y", ["a"], False)
    model = regress_candidates()["ransac"].fit(task, {"max_trials": 20})
    assert model.coefficients[0] == pytest.approx(3, abs=1e-6) and model.intercept == pytest.approx(1, abs=1e-6)


def test_knn_query_takes_the_whole_table(spark, folder):
    from tabprep.registry import queries

    parts = {r.p_partkey: float(r.p_retailprice) for r in spark.read.parquet(f"{folder}/part.parquet").collect()}
    found = {r.p_partkey: r.prediction for r in queries()["family_knn_whole"](spark, folder).collect()}
    assert found.keys() == parts.keys()
    for key, value in found.items():
        near = sorted(parts, key=lambda k: (abs(k - key), k))[:3]
        assert abs(float(value) - sum(parts[k] for k in near) / 3) < 1e-3
