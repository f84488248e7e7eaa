"""Streams: scoring of arriving records and monitoring of metric values."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import col, data_type, require
from ..ml.search import batch_score


def stream_score(sdf: DataFrame, steps: Sequence[Any], model: Any) -> DataFrame:
    """Fitted steps and a model applied to a stream; nothing is fitted on the way."""
    if not getattr(model, "streams", False):
        raise ValueError("this model needs the whole table and cannot score a stream")
    return batch_score(sdf, steps, model)


def monitor_metrics(
    df: DataFrame,
    limits: DataFrame | None,
    window: str = "1 hour",
    watermark: str | None = None,
    ts: str = "ts",
    by: Sequence[str] = ("d_id", "tag"),
    value: str = "value",
) -> DataFrame:
    """Mean and count per deployment, tag and time window, compared with limits (by…, tag_c_value).

    The same text serves a table and a stream; a stream needs a watermark to close windows. Hot
    deployments cost nothing extra: partial sums are made before the shuffle.
    """
    require(df, [ts, *by, value])
    plain = isinstance(data_type(df, ts), T.TimestampNTZType)
    # event time must be an instant; a time without zone is read in the session's zone
    rows = df.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, watermark) if watermark else df
    found = rows.groupBy(F.window(col(ts), window).alias("w"), *[col(b) for b in by]).agg(
        F.avg(col(value)).alias("tag_value"), F.count(col(value)).alias("n")
    )
    kind = "timestamp_ntz" if plain else "timestamp"
    edges = [F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end")]
    found = found.select(*edges, *[col(b) for b in by], "tag_value", "n")
    if limits is None:
        return found
    on = [b for b in by if b in limits.columns]
    joined = found.join(limits.select(*on, "tag_c_value"), on, "left")
    return joined.withColumn("breached", F.coalesce(F.col("tag_value") > F.col("tag_c_value"), F.lit(False)))


def to_parquet(sdf: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to files, all that is there now and then stop."""
    return (
        sdf.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

