from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.operators.bins import Bin, equal_frequency
from tabprep.operators.clip import Clip
from tabprep.operators.encode import Encode, apply_ordinal_levels, encode_ordinal, ordinal_levels
from tabprep.operators.impute import Impute
from tabprep.operators.levels import club_rare_levels, near_zero_variance, untrained_levels, trained_levels
from tabprep.operators.mathops import MathOp
from tabprep.operators.rows import check_null, remove_duplicates, remove_null, sanitize_names
from tabprep.operators.scale import Scale
from tabprep.plans.pipeline import Pipeline, PipelineModel
from tabprep.plans.preprocess import preprocess, preprocess_apply, preprocess_pipeline
from tabprep.plans.step import ColumnStep, register_step


def values(df, column, order="id"):
    return [r[0] for r in df.orderBy(order).select(F.col(f"`{column}`")).collect()]


def run(df, *steps):
    return Pipeline(steps).fit(df).transform(df)


@pytest.mark.parametrize(
    "strategy, fill, column, expected",
    [
        ("mean", None, "mpg", 23.2),
        ("median", None, "mpg", 24.0),
        ("most_frequent", None, "mpg", 18.0),
        ("", None, "mpg", 18.0),
        ("constant", 5.0, "mpg", 5.0),
        ("constant", "", "mpg", 10.0),
        ("constant", None, "mpg", 0.0),
    ],
)
def test_impute_number(cars, strategy, fill, column, expected):
    assert values(run(cars, Impute(column, strategy, fill)), column)[1] == pytest.approx(expected)


@pytest.mark.parametrize("fill, expected", [("", "DEFAULT"), (None, "missing_value"), ("x", "x")])
def test_impute_text(cars, fill, expected):
    assert values(run(cars, Impute("car", "constant", fill)), "car")[2] == expected


def test_most_frequent_takes_the_smallest_on_a_tie(cars):
    assert values(run(cars, Impute("car", "most_frequent")), "car")[2] == "fiat"


@pytest.mark.parametrize(
    "step", [lambda: Impute("car", "mean"), lambda: Impute("mpg", "constant", "a"), lambda: Scale("car"), lambda: Clip("car"), lambda: MathOp("car")]
)
def test_wrong_types_are_refused(cars, step):
    with pytest.raises(TypeError):
        run(cars, step())


def test_unknown_names_are_refused(cars):
    for bad in (lambda: Impute("mpg", "mode"), lambda: Scale("mpg", "other"), lambda: MathOp("mpg", "sqrt"), lambda: Bin("mpg", "tree")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        preprocess(cars, {"nothing": [{"impute": [{"imp_strategy": "mean"}]}]})
    with pytest.raises(ValueError):
        preprocess(cars, {"mpg": [{"polish": []}]})


def test_clip(cars):
    assert values(run(cars, Clip("delta", "value", 0, 4)), "delta") == [0, 2, None, 4, 0, 4]
    assert values(run(cars, Clip("delta", "value", "", 3.0)), "delta") == [-1, 2, None, 3, -5, 3]
    assert values(run(cars, Clip("mpg", "percentile", 0, 50)), "mpg") == [18, None, 24, 18, 24, 24]
    with pytest.raises(ValueError):
        run(cars, Clip("delta", "value", 4, 0))


def test_scale(cars):
    z = values(run(cars, Scale("delta", "standardscaler")), "delta")
    assert sum(v for v in z if v is not None) == pytest.approx(0)
    assert sum(v * v for v in z if v is not None) == pytest.approx(5)
    assert values(run(cars, Scale("delta", "minmaxscaler")), "delta")[4:] == [0.0, 1.0]
    assert values(run(cars, Scale("delta", "maxabsscaler")), "delta")[4:] == [pytest.approx(-5 / 6), 1.0]
    # median 2, quartiles -1 and 4
    assert values(run(cars, Scale("delta", "robustscaler")), "delta")[0] == pytest.approx(-0.6)
    for method in ("standardscaler", "minmaxscaler", "robustscaler"):
        assert values(run(cars, Scale("same", method)), "same") == [0.0] * 6


@pytest.mark.parametrize(
    "operation, value, expected",
    [
        ("log", 10, [None, 0.30103, None]),
        ("power", 2, [1.0, 4.0, None]),
        ("add", "", [9.0, 12.0, None]),
        ("sub", 1, [-2.0, 1.0, None]),
        ("mul", 3, [-3.0, 6.0, None]),
        ("div", 0, [None, None, None]),
        ("reciprocal", None, [-1.0, 0.5, None]),
        ("nthroot", 2, [None, 1.41421, None]),
        ("exp", None, [0.36788, 7.38906, None]),
    ],
)
def test_mathops(cars, operation, value, expected):
    got = values(run(cars, MathOp("delta", operation, value)), "delta")[:3]
    assert got == [e if e is None else pytest.approx(e, abs=1e-5) for e in expected]


def test_boxcox(cars, spark):
    with pytest.raises(ValueError):
        run(cars, MathOp("delta", "boxcox"))
    skewed = spark.range(1, 400).select(F.col("id"), F.exp(F.col("id") / 80.0).alias("v"))
    model = Pipeline([MathOp("v", "boxcox")]).fit(skewed)
    lam = model.step("v", "mathops").state["lambda"]
    # the likelihood at the fitted lambda beats its neighbours
    def llf(l):
        y = F.ln("v") if l == 0 else (F.pow("v", F.lit(l)) - 1) / l
        import math
        n, s, var = skewed.agg(F.count("v"), F.sum(F.ln("v")), F.var_pop(y)).first()
        return (l - 1) * s - n / 2 * math.log(var)
    assert llf(lam) >= max(llf(lam - 0.02), llf(lam + 0.02))


def test_bins(cars):
    assert values(run(cars, Bin("delta", "kbins", 2)), "delta") == [0, 1, None, 1, 0, 1]
    assert values(run(cars, Bin("mpg", "equal length", 4)), "mpg") == [0, None, 1, 0, 2, 2]
    assert values(run(cars, Bin("same", "kbins", 3)), "same") == [0] * 6
    assert values(equal_frequency(cars, "delta", 2, ["id"]), "delta") == [0, 1, None, 1, 0, 2]
    with pytest.raises(ValueError):
        run(cars, Bin("delta", "kbins", 1))


def test_bin_edges_go_up(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)], "id int, v double")
    assert values(run(df, Bin("v", "kbins", 5)), "v") == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4]


def test_ordinal(cars, spark):
    model = Pipeline([Encode("car")]).fit(cars)
    assert values(model.transform(cars), "car") == [2, 1, None, 2, 0, 1]
    other = spark.createDataFrame([(1, "saab")], "id int, car string")
    with pytest.raises(Exception, match="unseen level"):
        model.transform(other).collect()
    levels = ordinal_levels(cars, "car")
    assert values(apply_ordinal_levels(cars, "car", levels), "car") == [2, 1, None, 2, 0, 1]
    with pytest.raises(Exception, match="unseen level"):
        apply_ordinal_levels(other, "car", levels).collect()


def test_ordinal_beyond_the_literal_limit(spark):
    df = spark.range(3000).select(F.col("id"), F.format_string("v%05d", 2999 - F.col("id")).alias("v"))
    assert values(encode_ordinal(df, "v"), "v") == list(range(2999, -1, -1))
    model = Pipeline([Encode("v")]).fit(df)
    again = type(model).from_json(model.to_json())
    assert values(again.transform(df.limit(5)), "v") == [2999, 2998, 2997, 2996, 2995]
    with pytest.raises(ValueError, match="max_levels"):
        Pipeline([Encode("v", "onehot encoder")]).fit(df)
    assert len(Pipeline([Encode("v", "onehot encoder", 30)]).fit(df.where("id < 30")).transform(df).columns) == 31


def test_zero_has_one_sign(spark):
    df = spark.createDataFrame([(i, -0.0 if i % 2 else 0.0 if i % 4 else float(i)) for i in range(2500)], "id int, v double")
    levels = ordinal_levels(df, "v")
    codes = {r["id"]: r["v"] for r in apply_ordinal_levels(df, "v", levels).collect()}
    assert len(codes) == 2500 and {codes[i] for i in range(1, 100, 2)} == {0}


def test_boxcox_finds_the_peak_wherever_it_lies(spark):
    rng = np.random.default_rng(3)
    for lam in (0.1266, 9.0, -7.5):
        z = 1 + lam * rng.normal(2.0 if lam > 0 else -2.0, 0.02, 4000)
        rows = [(i, float(v ** (1 / lam))) for i, v in enumerate(z) if v > 0]
        step = MathOp("v", "boxcox")
        Pipeline([step]).fit(spark.createDataFrame(rows, "id int, v double"))
        x = np.log(np.array([v for _, v in rows]))

        def likelihood(p):
            return (p - 1) * x.sum() - len(x) / 2 * np.log(np.var(np.expm1(p * x) / p))

        found = step.state["lambda"]
        assert all(likelihood(found) >= likelihood(found + d) - 1e-6 for d in (-1e-3, 1e-3, -0.1, 0.1, 1.0, -1.0))


def test_onehot(cars, spark):
    model = Pipeline([Encode("car", "onehot encoder")]).fit(cars)
    out = model.transform(cars)
    names = [f"Trans_car__x0_{c}" for c in ("audi", "fiat", "ford")]
    assert out.columns[:3] == names
    assert values(out, names[1]) == [0, 1, 0, 0, 0, 1]
    unseen = model.transform(spark.createDataFrame([("saab",)], "car string")).first()
    assert list(unseen) == [0.0, 0.0, 0.0]


SPEC = {
    "mpg": [{"impute": [{"imp_strategy": "median"}]}, {"clip": [{"method": "percentile"}, {"u_min": 10}, {"u_max": 90}]}, {"scale": [{"scale_method": ""}]}],
    "car": [{"impute": [{"imp_strategy": ""}]}, {"encode": [{"enc_method": "onehot encoder"}]}],
    "delta": [{"removenull": []}, {"mathops": [{"mathops_operation": "power"}, {"mathops_value": 2}]}, {"bin_variables": [{"bin_method": "kbins"}, {"bin_value": 3}]}],
}


def test_request_order_and_target(cars):
    out = preprocess(cars, SPEC, target="same")
    assert out.columns[0] == "mpg" and out.columns[-1] == "same" and out.columns[1].startswith("Trans_car")
    assert out.columns[-4:] == ["id", "cylinders", "acceleration", "same"]
    assert out.count() == 5  # the row without delta is gone


def test_saved_model_gives_the_same(cars, spark, tmp_path):
    model = preprocess_pipeline(cars, SPEC)
    model.save(spark, str(tmp_path / "m"))
    again = PipelineModel.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, model.transform(cars).collect()), key=str) == sorted(map(tuple, again.transform(cars).collect()), key=str)
    assert preprocess_apply(cars, again).count() == 6


def test_partitioning_does_not_matter(cars):
    one = sorted(map(tuple, preprocess(cars.coalesce(1), SPEC).collect()), key=str)
    many = sorted(map(tuple, preprocess(cars.repartition(5), SPEC).collect()), key=str)
    assert one == many


def test_waves_share_jobs(spark, folder):
    """Twenty columns are fitted in as many jobs as one."""
    df = spark.range(1000).select(*[(F.rand(i) * 10).alias(f"c{i}") for i in range(20)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns):
        spark.sparkContext.setJobGroup(f"fit{columns}", "")
        Pipeline([s for i in range(columns) for s in (Clip(f"c{i}", "value"), Scale(f"c{i}"))]).fit(df)
        found = len(tracker.getJobIdsForGroup(f"fit{columns}"))
        spark.sparkContext.setJobGroup("rest", "")
        return found

    assert jobs(20) == jobs(1)


def test_own_step(cars):
    @register_step
    class Double(ColumnStep):
        action = "double"

        def expression(self, x):
            return x * 2

    assert values(preprocess(cars, {"mpg": [{"double": []}]}), "mpg")[0] == 36.0


def test_rows(cars, spark):
    assert remove_null(cars, "mpg").count() == 5
    assert check_null(cars, "mpg", "impute") == 1
    with pytest.raises(ValueError):
        check_null(cars, "mpg", "clip")
    twice = spark.createDataFrame([(3, 1, "a", "x"), (1, 1, "a", "y"), (2, 2, "b", "z")], "id int, p int, q string, y string")
    assert sorted(map(tuple, remove_duplicates(twice, ["id"], "y").collect())) == [(1, 1, "a", "y"), (2, 2, "b", "z")]
    assert sanitize_names(twice.toDF("i d", "p#", "q.1", "y_y")).columns == ["id", "p", "q1", "y_y"]
    with pytest.raises(ValueError):
        sanitize_names(twice.toDF("a b", "ab", "c", "d"))


def test_levels(spark):
    rows = [(i, "a" if i < 60 else "b" if i < 98 else f"r{i}", 1, i) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, v string, same int, other int")
    assert {r[0] for r in club_rare_levels(df, "v").select("v").distinct().collect()} == {"a", "b", "others_infrequent"}
    assert near_zero_variance(df).columns == ["id", "v", "other"]
    new = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, v string")
    assert values(untrained_levels(new, "v", trained_levels(df, "v")), "v") == ["a", "r98", None]


def test_row_level_plans_have_no_python_and_no_single_partition(spark, folder, capsys):
    from tabprep.registry.views import table

    df = table(spark, folder, "customer_gap")
    spec = {
        "c_acctbal": [{"impute": [{"imp_strategy": "median"}]}, {"scale": [{"scale_method": ""}]}],
        "c_mktsegment": [{"impute": [{"imp_strategy": ""}]}, {"encode": [{"enc_method": "onehot encoder"}]}],
    }
    preprocess(df, spec).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan
    assert "c_nationkey" in plan.split("ReadSchema")[1]


def test_long_decimals_stay_apart(spark):
    """Twenty digits and a scale survive levels, mode, mean and a saved model; the column's type stays."""
    a, b = Decimal("12345678901234567890.12"), Decimal("12345678901234567890.13")
    df = spark.createDataFrame([(1, a), (2, b), (3, b), (4, None)], "id int, v decimal(30,2)")

    def done(*actions):
        model = preprocess_pipeline(df, {"v": list(actions)})
        return PipelineModel.from_json(model.to_json()).transform(df).orderBy("id")

    filled = done({"impute": [{"imp_strategy": "most_frequent"}]})
    assert filled.schema["v"].dataType.simpleString() == "decimal(30,2)"
    assert [r["v"] for r in filled.collect()] == [a, b, b, b]
    coded = done({"encode": [{"enc_method": "ordinal encoder"}]})
    assert [r["v"] for r in coded.collect()] == [0, 1, 1, None]
    hot = done({"encode": [{"enc_method": "onehot encoder"}]})
    named = [i for i, c in enumerate(hot.columns) if c.startswith("Trans_v__x0_")]
    assert [tuple(r[i] for i in named) for r in hot.collect()] == [(1.0, 0.0), (0.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    mean = done({"impute": [{"imp_strategy": "mean"}]}).collect()[3]["v"]
    assert abs(mean - (a + 2 * b) / 3) < Decimal("0.001")
