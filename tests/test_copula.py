"""The copula generator against distributions, correlations and formulas known otherwise."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.functions.normal import normal_score, normal_share
from tabprep.operators import copula as cp


def distance(a, b):
    """Largest difference of two samples' distribution functions."""
    at = np.sort(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)).max()


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(6000, numPartitions=4).select("id", F.randn(1).alias("z"), F.randn(2).alias("e"))
    return df.select(
        "id",
        F.exp("z").alias("skewed"),
        (F.col("z") * 0.8 + F.col("e") * 0.6).alias("near"),
        F.when(F.col("z") > 0.5, "c").when(F.col("z") > -1, "b").when(F.col("z") > -1.5, "a").alias("t"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("hot"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("e")).alias("holes"),
        (F.col("id") % 2 == 0).alias("even"),
        F.lit(7).alias("same"),
    ).cache()


def test_normal_distribution(spark):
    shares = [1e-12, 1e-6, 0.001, 0.02425, 0.3, 0.5, 0.75, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(p, NormalDist().inv_cdf(p)) for p in shares], "p double, x double")
    for p, x, score, share in rows.select("p", "x", normal_score(F.col("p")), normal_share(F.col("x"))).collect():
        assert score == pytest.approx(x, abs=1e-7) and share == pytest.approx(p, abs=1e-7)


def test_distributions_and_correlations(table):
    made = cp.copula_rows(table, 20_000, skip=["id"]).where("id is null").toPandas()
    old = table.toPandas()
    assert len(made) == 20_000
    for c in ("skewed", "near", "hot", "holes"):
        assert distance(old[c].dropna().to_numpy(), made[c].dropna().to_numpy()) < 0.02, c
    for c in ("t", "even"):
        shares = old[c].value_counts(normalize=True, dropna=False) - made[c].value_counts(normalize=True, dropna=False)
        assert shares.abs().max() < 0.02, c
    assert abs(made["holes"].isna().mean() - 0.2) < 0.01
    assert (made["same"] == 7).all()
    by_rank = [d["skewed"].rank().corr(d["near"].rank()) for d in (made, old)]
    assert by_rank[0] == pytest.approx(by_rank[1], abs=0.02)
    assert made[made.t == "c"].near.mean() > made[made.t == "a"].near.mean() + 0.8
    assert dict(cp.copula_rows(table, 5).dtypes) == dict(table.dtypes)


def test_scores_by_hand(spark):
    """Mean ranks, normal quantiles and their correlation, against numpy."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 300).astype(float), rng.normal(size=300)
    y += x / 4
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double").repartition(5)

    def scores(v):
        ranks = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        return np.array([NormalDist().inv_cdf((r - 0.5) / len(v)) for r in ranks])

    want = np.corrcoef(scores(x), scores(y))[0, 1]
    assert cp.copula_correlations(df, ["x", "y"]).first()["corr"] == pytest.approx(want, abs=1e-7)


def test_classes_have_their_own_copula(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "few").otherwise("many").alias("y"), F.randn(1).alias("a"), F.randn(2).alias("e"))
    df = df.withColumn("b", F.when(F.col("y") == "few", -F.col("a")).otherwise(F.col("a")) * 3 + F.col("e") / 10).drop("e")
    out = cp.copula_class(df, "y", skip=["id"])
    made = out.where("id is null")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"few": 3000, "many": 3000}
    assert {r[0] for r in made.select("y").distinct().collect()} == {"few"}
    assert made.agg(F.corr("a", "b")).first()[0] < -0.97
    assert cp.copula_class(df.where("id < 4 and id > 1"), "y").count() == 2


def test_many_columns_take_the_blocks(spark):
    df = spark.range(800).select(*[F.randn(i).alias(f"c{i}") for i in range(26)])
    df = df.withColumn("twin", F.col("c3"))
    made = cp.copula_rows(df, 1500).subtract(df)
    got = made.agg(F.corr("c3", "twin"), F.corr("c1", "c2"), F.count("c1")).first()
    assert got[0] > 0.999 and abs(got[1]) < 0.15 and got[2] == 1500


def test_many_levels_and_edges(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("t"))
    made = cp.copula_rows(df, 9000).toPandas()[3000:]
    assert abs((made.t == "hot").mean() - 1 / 3) < 0.02 and made.t.nunique() > 1800
    assert cp.copula_rows(df.limit(0), 10).count() == 0
    assert {r[0] for r in cp.copula_rows(df.limit(1), 10).collect()} == {"hot"}
    gaps = spark.createDataFrame([(None, None), (None, None)], "a double, b string")
    assert {tuple(r) for r in cp.copula_rows(gaps, 4).collect()} == {(None, None)}
    nan = spark.createDataFrame([(float("nan"),), (-0.0,), (0.0,)], "a double")
    assert {r[0] for r in cp.copula_rows(nan, 40).collect()[3:]} == {None, 0.0}
    with pytest.raises(TypeError):
        cp.copula_rows(spark.createDataFrame([([1],)], "a array<int>"), 3)


def test_ranks_of_frequent_values_are_not_gathered(spark, monkeypatch):
    """Rows of a frequent value stay where they are, tasks are as many as the rows need, gaps and rare values find their rank too."""
    from tabprep.operators import correlate as cr

    monkeypatch.setattr(cr, "TASK_ROWS", 100)
    monkeypatch.setattr(cr, "HOT_VALUES", 20)
    df = spark.range(900).selectExpr("case when id % 3 = 0 then null else id % 2 end as x", "id * 7 % 900 as y", "concat('t', id % 4) as t")
    melted = df.select(F.monotonically_increasing_id().alias("__row"), F.posexplode(F.array(F.col("y") % 2, "y")).alias("column", "value"))
    ranks = melted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("off", F.col("value") * 2)
    met = cr.with_ranks(melted, ranks, 1800, "off")
    assert met.count() == 1800 and met.where("off <> value * 2").isEmpty()
    assert cr.melted_parts(df, 1800) == 18 and cr.melted_parts(df, 0) == 4
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "REPARTITION_BY_NUM" in plan
    pdf = df.toPandas()
    got = cr.corr_spearman(df.selectExpr("y % 5 as a", "y as b"), ["a", "b"]).first()["corr"]
    assert got == pytest.approx((pdf.y % 5).rank().corr(pdf.y.rank()), abs=1e-9)
    shared = cp.fit_copula(df, ["x", "y", "t"])
    monkeypatch.undo()
    plain = cp.fit_copula(df, ["x", "y", "t"])
    assert np.allclose(shared.correlations[""], plain.correlations[""], atol=1e-9) and shared.gaps == plain.gaps == {("", 0): 1 / 3}
