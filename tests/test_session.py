import time

from pyspark.sql import functions as F

from tabprep.llm.graph import components
from tabprep.session import REMOVES_SHUFFLES, pinned, scratch_path, stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def left_by(spark, work):
    """Shuffle files that are new and do not go within ten seconds."""
    before = shuffle_files(spark)
    out = work()
    for _ in range(100):
        if not (more := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return out, more


def counted(spark):
    return spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count()


def test_stored_frames_leave_no_shuffles(spark):
    found, more = left_by(spark, lambda: pinned(counted(spark)))
    assert not more and sum(r["count"] for r in found.collect()) == 1000
    path = scratch_path(spark, "counted")
    _, more = left_by(spark, lambda: stored(counted(spark), path))
    assert not more and spark.read.parquet(path).count() == 7
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    found, more = left_by(spark, lambda: components(links))
    assert not more and {r["label"] for r in found.collect()} == {0}


def test_frames_used_again_keep_theirs(spark):
    """A frame is still run, as it was, after what was made of it is stored, and the caller's setting holds."""
    mine = counted(spark)
    first = sorted(mine.collect())
    kept = pinned(mine)
    assert sorted(kept.collect()) == sorted(mine.collect()) == first
    assert spark.conf.get(REMOVES_SHUFFLES, None) is None
    held = mine.persist()
    assert sorted(held.collect()) == sorted(pinned(held).collect()) == sorted(held.collect()) == first
    held.unpersist()
    spark.conf.set(REMOVES_SHUFFLES, "false")
    try:
        pinned(mine)
        assert spark.conf.get(REMOVES_SHUFFLES) == "false"
    finally:
        spark.conf.unset(REMOVES_SHUFFLES)
