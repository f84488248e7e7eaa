import numpy as np
from pyspark.sql import functions as F

from tabprep.ml.candidates import make_task, regress_candidates
from tabprep.operators import layers as module
from tabprep.operators.layers import Layers, recall
from tabprep.operators.neighbors import knn_join
from tabprep.operators.smote import smote, smote_nc

NAMES = [f"x{i}" for i in range(8)]


def table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 4
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8))
    rows = [(i, *map(float, v), ["a", "b"][i % 2], "yes" if i % 9 else "no") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in NAMES) + ", s string, y string").repartition(3)


def test_recall_on_embeddings(spark, folder):
    vectors = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/embeddings.parquet")
    names = [f"e{i}" for i in range(64)]
    df = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    exact = knn_join(df, df, names, 5, "vec_id")
    # these vectors point in all directions alike, the hardest case: most of about 21 cells have to be searched
    found = knn_join(df, df, names, 5, "vec_id", layered=15, one_cell=24)
    assert found.count() == exact.count() and recall(found, exact, "vec_id") >= 0.9


def test_few_cells_do_where_points_cluster(spark):
    """Two of about 36 cells find nine tenths of the neighbours."""
    df = table(spark, 1800, 7)
    found = knn_join(df, df, NAMES, 5, "id", layered=2, one_cell=50)
    assert found.count() == 9000 and recall(found, knn_join(df, df, NAMES, 5, "id"), "id") >= 0.9


def test_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5))
    index = Layers.of(x[:300], 40, 100)
    cells = index.cell(x)
    assert 25 <= len(index) <= 55 and cells.min() >= 100 and cells.max() < 100 + len(index)
    sizes = np.bincount(cells, minlength=100 + len(index))
    near = index.around(x, 3, 50, sizes)
    assert all(len(c) >= 3 and sizes[c].sum() >= 50 and len(set(c)) == len(c) for c in near)
    assert np.mean([c in n for c, n in zip(cells, near)]) > 0.9  # a row's own cell is among them
    everything = index.around(x[:2], 1, 10**6, sizes)
    assert all(sizes[c].sum() == 900 for c in everything)


def test_groups_categories_and_small_groups(spark):
    """Every row gets its k neighbours, of its own group, with exact distances; hot points and small groups too."""
    df = table(spark, 900).unionByName(spark.range(5000, 5300).select(F.col("id").cast("int").alias("id"), *[F.lit(1.0).alias(c) for c in NAMES], F.lit("a").alias("s"), F.lit("yes").alias("y")))
    df = df.withColumn("y", F.when(F.col("id") < 4, "rare").otherwise(F.col("y")))
    options = {"by": "y", "categorical": ["s"], "mismatch": {"yes": 0.5, "no": 0.5, "rare": 0.5}}
    exact = knn_join(df, df, NAMES, 3, "id", **options)
    found = knn_join(df, df, NAMES, 3, "id", layered=6, one_cell=50, **options)
    assert found.groupBy("id").count().where("count <> 3").isEmpty() and found.count() == exact.count() == 3600
    assert recall(found, exact, "id") > 0.9
    distance = {(r["id"], r["neighbour"]): r["distance"] for r in exact.collect()}
    assert all(abs(distance[r["id"], r["neighbour"]] - r["distance"]) < 1e-9 for r in found.collect() if (r["id"], r["neighbour"]) in distance)


def test_all_cells_are_exact(spark):
    df = table(spark, 400, 2)
    exact = knn_join(df, df, NAMES, 4, "id").select("id", "place", "neighbour").collect()
    found = knn_join(df, df, NAMES, 4, "id", layered=10_000, one_cell=20).select("id", "place", "neighbour").collect()
    wide, module.WIDE = module.WIDE, 10_000
    try:
        every = knn_join(df, df, NAMES, 4, "id", layered=10_000, one_cell=20).select("id", "place", "neighbour").collect()
    finally:
        module.WIDE = wide
    assert sorted(every) == sorted(exact) and len(set(found) & set(exact)) > 0.95 * len(exact)


def test_smote_by_layers(spark):
    df = table(spark, 600)
    made = smote(df.drop("s"), "y", "auto", 5, "id", layered=3)
    assert {r["y"]: r["count"] for r in made.groupBy("y").count().collect()}["no"] == df.where("y = 'yes'").count()
    mixed = smote_nc(df, "y", ["s"], "auto", 5, "id", layered=3)
    assert mixed.count() == made.count()


def test_nothing(spark):
    none = table(spark, 30).where("id < 0")
    assert knn_join(none, none, NAMES, 2, "id", layered=3).count() == 0


def test_knn_by_layers(spark):
    df = table(spark, 500, 9).withColumn("x0", F.when(F.col("id") > 4, F.col("x0")))
    settings = {"n_neighbors": 5, "weights": "uniform"}
    task = make_task(df, "x1", [c for c in NAMES if c != "x1"], False)
    exact, near = (regress_candidates()["knn"].fit(task, {**settings, **more}).transform(df) for more in ({}, {"layered": 4}))
    said = {r["id"]: r["prediction"] for r in exact.collect()}
    assert sorted(i for i, v in said.items() if v is None) == [0, 1, 2, 3, 4]  # a gap has no neighbours
    assert np.mean([said[r["id"]] == r["prediction"] for r in near.collect()]) > 0.9
