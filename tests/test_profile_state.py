"""Merged profile states against the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprep.operators.profile_state import SHARES, merged, profile_of, profile_state, save_state


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(30_000, numPartitions=5).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.exp(F.randn(4))).alias("skewed"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).cast("int").alias("hot"),
        F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").alias("t"),
        F.lit(None).cast("double").alias("none"),
    ).cache()


def test_parts_make_the_whole(spark, table, tmp_path):
    parts = [table.where("key < 9000"), table.where("key >= 9000 and key < 9010"), table.where("key >= 9010")]
    paths = [save_state(profile_state(p), f"{tmp_path}/version_id={i}") for i, p in enumerate(parts)]
    with pytest.raises(Exception):
        save_state(profile_state(parts[0]), f"{tmp_path}/version_id=0")
    found = {r["column"]: r for r in profile_of(merged(*[spark.read.parquet(p) for p in paths])).collect()}
    rows = table.toPandas()
    assert set(found) == set(rows.columns)
    for c in ("key", "skewed", "hot"):
        r, v = found[c], rows[c].dropna().to_numpy(float)
        assert (r["rows"], r["missing"], r["min"], r["max"], r["zeros"]) == (30_000, 30_000 - len(v), v.min(), v.max(), (v == 0).sum())
        assert r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(ddof=1))
        for p in SHARES:
            q = r[f"p{round(p * 100)}"]
            assert (v < q).mean() - 0.003 <= p <= (v <= q).mean() + 0.003
        assert r["distinct"] == pytest.approx(len(np.unique(v)), rel=0.04)
    assert [(f["item"], f["count"]) for f in found["t"]["frequent"]] == [("a", 18_000), ("b", 9_000)]
    assert (found["hot"]["frequent"][0]["item"], found["hot"]["frequent"][0]["count"]) == ("0", int((rows.hot == 0).sum()))
    assert (found["t"]["missing"], found["t"]["p50"], found["t"]["zeros"], found["t"]["distinct"]) == (3000, None, None, 2)
    assert (found["none"]["missing"], found["none"]["mean"], found["none"]["p50"], list(found["none"]["frequent"])) == (30_000, None, None, [])


def test_one_state_is_itself(table):
    alone, again = (profile_of(s).orderBy("column").collect() for s in (profile_state(table, ["hot", "t"]), merged(profile_state(table, ["hot", "t"]))))
    for a, b in zip(alone, again):
        assert a["mean"] == pytest.approx(b["mean"]) and (a["p50"], a["distinct"], a["frequent"]) == (b["p50"], b["distinct"], b["frequent"])


def test_empty_parts_and_missing_columns(spark, table):
    whole, none = profile_state(table, ["hot"]), profile_state(table.limit(0), ["hot"])
    assert none.count() == 0 and profile_of(merged(none)).count() == 0
    found = {r["column"]: r for r in profile_of(merged(whole, none, profile_state(table, ["t"]))).collect()}
    assert (found["hot"]["rows"], found["t"]["rows"]) == (30_000, 30_000)
    with pytest.raises(ValueError):
        merged()
