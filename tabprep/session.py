"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a checkpoint's files go when nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tabprep", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC, AQE and skew joins on; a caller's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    Only a local master gets a folder of this machine when the setting is absent.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="tabprep-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is made and run inside removes its shuffle files as it ends; else they stay until the driver collects its garbage.

    For frames that are run once, as those that are stored.
    """
    before = spark.conf.get(REMOVES_SHUFFLES, None)
    spark.conf.set(REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVES_SHUFFLES)
        else:
            spark.conf.set(REMOVES_SHUFFLES, before)


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are on shared storage and never computed again, and their shuffles are gone."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting holds for frames made under it


def stored(df: DataFrame, path: str) -> None:
    """Written as Parquet to a folder of the shared storage; its shuffles are gone."""
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
