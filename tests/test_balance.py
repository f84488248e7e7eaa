import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.operators.balance import problem_type, random_oversample, random_undersample, task_type, wanted_rows
from tabprep.operators.profile import profile_numeric
from tabprep.operators.smote import smote, smote_nc
from tabprep.operators.synth import distribution_compare, synthesize_class, synthesize_rows


@pytest.fixture(scope="module")
def classes(spark):
    rows = [(i, float(i % 17), float(i % 5) * 3, "ab"[i % 2], "big" if i % 8 else "small") for i in range(160)]
    return spark.createDataFrame(rows, "id int, p double, q double, c string, y string")


COUNTS = {"a": 10, "b": 4, "c": 7}


@pytest.mark.parametrize(
    "method, strategy, expected",
    [
        ("SMOTE", "auto", [10, 10, 10]),
        ("SMOTE", "minority", [10, 10, 7]),
        ("SMOTE", "not minority", [10, 4, 10]),
        ("Random Oversampler", "all", [10, 10, 10]),
        ("Random Undersampler", "auto", [4, 4, 4]),
        ("Random Undersampler", "majority", [4, 4, 7]),
        ("Random Undersampler", "not majority", [10, 4, 4]),
        ("Random Undersampler", {"a": 5, "b": 4, "c": 5}, [5, 4, 5]),
    ],
)
def test_targets(method, strategy, expected):
    assert list(wanted_rows(COUNTS, method, strategy).values()) == expected


@pytest.mark.parametrize(
    "counts, method, strategy",
    [
        ({"a": 3}, "SMOTE", "auto"),
        (COUNTS, "SMOTE", "majority"),
        (COUNTS, "SMOTE", 0.5),
        (COUNTS, "SMOTE", {"a": 10}),
        (COUNTS, "SMOTE", {"a": 9, "b": 4, "c": 7}),
        (COUNTS, "Random Undersampler", {"a": 11, "b": 4, "c": 7}),
        (COUNTS, "Other", "auto"),
    ],
)
def test_bad_targets(counts, method, strategy):
    with pytest.raises(ValueError):
        wanted_rows(counts, method, strategy)


def test_ratio():
    assert wanted_rows({"a": 100, "b": 10}, "SMOTE", 0.5) == {"a": 100, "b": 50}
    assert wanted_rows({"a": 100, "b": 10}, "Random Undersampler", 0.5) == {"a": 20, "b": 10}


def sizes(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def test_random_sampling(classes):
    over = random_oversample(classes, "y", "auto", ["id"])
    assert sizes(over) == {"big": 140, "small": 140}
    assert over.join(classes, ["id", "p", "q", "c", "y"], "left_anti").count() == 0
    under = random_undersample(classes, "y", "auto", ["id"])
    assert sizes(under) == {"big": 20, "small": 20}
    assert under.select("id").distinct().count() == 40
    same = random_undersample(classes.repartition(7), "y", "auto", ["id"])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, under.collect()))


def test_smote_points_lie_between_two_rows(classes):
    made = smote(classes.drop("c"), "y", "auto", 3, "id")
    assert sizes(made) == {"big": 140, "small": 140}
    base = np.array([tuple(r) for r in classes.where("y = 'small'").select("p", "q").collect()])
    for r in made.where("id is null").collect():
        x = np.array([r["p"], r["q"]])
        best = np.inf
        for a in base:
            for b in base:
                d = b - a
                t = 0.0 if not d.any() else np.clip((x - a) @ d / (d @ d), 0, 1)
                best = min(best, np.abs(a + t * d - x).max())
        assert best < 1e-9


def test_smote_nc(classes):
    made = smote_nc(classes, "y", ["c"], "auto", 3, "id")
    assert sizes(made) == {"big": 140, "small": 140}
    assert {r[0] for r in made.where("id is null").select("c").distinct().collect()} <= {"a", "b"}
    with pytest.raises(ValueError):
        smote_nc(classes, "y", [], "auto", 3, "id")


def test_generated_rows_follow_the_table(spark):
    df = spark.range(2000).select(
        F.col("id"), (F.randn(1) * 3 + 10).alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("t"), F.col("id").cast("int").alias("n")
    )
    df = df.withColumn("b", F.col("a") * 2 + F.randn(2))
    made = synthesize_rows(df, 2000, skip=["id"]).where("id is null")
    assert made.count() == 2000
    stats = made.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b")).first()
    assert stats[0] == pytest.approx(10, abs=0.4) and stats[1] == pytest.approx(3, abs=0.4) and stats[2] > 0.95
    assert made.schema["n"].dataType.simpleString() == "int"
    assert {r[0] for r in made.select("t").distinct().collect()} <= {"x", "y"}
    filled = synthesize_class(df, "t", skip=["id"])
    assert len({r["count"] for r in filled.groupBy("t").count().collect()}) == 1
    assert distribution_compare(df, made, ["a", "b"]).count() == 4


def test_kinds_of_problem(classes):
    assert problem_type(classes, "y") == "binary" and problem_type(classes, "q") == "multi"
    assert task_type(classes, "y") == "classification" and task_type(classes, "id") == "regression"
    with pytest.raises(ValueError):
        problem_type(classes.where("y = 'big'"), "y")


def test_smote_refuses_gaps_and_repeated_keys(spark):
    rows = [(i, float(i % 17) if i % 9 else None, "pos" if i % 5 == 0 else "neg") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, c string")
    with pytest.raises(ValueError, match="missing values in x"):
        smote(df, "c")
    with pytest.raises(ValueError, match="not a key"):
        smote(df.na.fill(0.0).withColumn("id", F.col("id") % 3), "c")
    done = smote(df.na.fill(0.0), "c").groupBy("c").count().collect()
    assert {r["count"] for r in done} == {160}


def test_decimals_keep_their_digits(spark):
    df = spark.createDataFrame([("1234567890123456789012345678.01",), ("1234567890123456789012345678.02",)], "s string")
    df = df.selectExpr("cast(s as decimal(30,2)) as v")
    assert profile_numeric(df).first()["distinct"] == 2
