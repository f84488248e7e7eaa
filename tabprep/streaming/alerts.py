"""Breaches as events: a stream that says once that a metric left its limit and once that it came back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import col, data_type, require

WAITING = "ms array<long>, value array<double>, limit array<double>"


def turned(rows: Iterable[tuple], raised: bool, streak: int, since: int, raise_after: int, clear_after: int) -> Iterator[tuple]:
    """Passes rows (ms, value, limit) in order; yields (raised, streak, since, row, changed) after each.

    `streak` counts the latest rows in a row that speak against the present state, `since` is the first of them.
    """
    for row in rows:
        ms, value, limit = row
        if (value > limit) == raised:
            streak = 0
        else:
            since = since if streak else ms
            streak += 1
        changed = streak >= (clear_after if raised else raise_after)
        if changed:
            raised, streak = not raised, 0
        yield raised, streak, since, row, changed


def breach_events(
    sdf: DataFrame,
    watermark: str,
    ts: str = "window_start",
    by: Sequence[str] = ("d_id", "tag"),
    value: str = "tag_value",
    limit: str | Column = "tag_c_value",
    raise_after: int = 1,
    clear_after: int = 1,
) -> DataFrame:
    """(by…, ts, event, since, value, limit): `raised` when `raise_after` rows of a key in a row exceed their limit, `cleared`
    when `clear_after` in a row do not, and nothing in between; `since` is the first row of that run.

    A key's rows are judged in the order of ts (ties by value), whatever order they arrive in: they wait until the watermark has
    passed them, and rows older than it are left out. A row without ts, value or limit says nothing; a null key is a key of its own. State per key is one flag, two numbers
    and the rows still waiting, kept in the query's checkpoint, so a restarted stream neither repeats nor forgets a breach.
    Feed it windows (`monitor_metrics`) rather than raw values, so that no key has many rows.
    """
    if min(raise_after, clear_after) < 1:
        raise ValueError("a run has one row or more")
    require(sdf, [ts, *by, value])
    plain = isinstance(data_type(sdf, ts), T.TimestampNTZType)
    names = [f"k{i}" for i in range(len(by))]
    kinds = [data_type(sdf, b).simpleString() for b in by]
    bound = col(limit) if isinstance(limit, str) else limit
    rows = sdf.select(
        *[col(b).alias(n) for b, n in zip(by, names)],
        col(ts).cast("timestamp").alias("at"),
        col(value).cast("double").alias("value"),
        bound.cast("double").alias("limit"),
    )
    rows = rows.withWatermark("at", watermark).withColumn("ms", F.unix_millis("at")).where("ms is not null and value is not null and limit is not null")
    key_schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raised, streak, since, *waiting = state.get if state.exists else (False, 0, 0, [], [], [])
        held = list(zip(*waiting))
        for frame in frames:
            held += zip(frame["ms"].tolist(), frame["value"].tolist(), frame["limit"].tolist())
        passed = state.getCurrentWatermarkMs()
        ready, held = sorted(r for r in held if r[0] < passed), [r for r in held if r[0] >= passed]
        out = []
        for raised, streak, since, row, changed in turned(ready, raised, streak, since, raise_after, clear_after):
            if changed:
                out.append((*key, row[0], "raised" if raised else "cleared", since, row[1], row[2]))
        state.update((raised, streak, since, *[[r[i] for r in held] for i in range(3)]))
        if held:  # called again when the watermark has passed the first of them
            state.setTimeoutTimestamp(max(min(r[0] for r in held), passed + 1))
        if out:
            yield pd.DataFrame(out, columns=[*names, "ms", "event", "since", "value", "limit"])

    found = rows.groupBy(*names).applyInPandasWithState(
        step,
        f"{key_schema}, ms long, event string, since long, value double, limit double",
        f"raised boolean, streak int, since long, {WAITING}",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    kind = "timestamp_ntz" if plain else "timestamp"
    return found.select(
        *[F.col(n).alias(b) for n, b in zip(names, by)],
        F.timestamp_millis("ms").cast(kind).alias(ts),
        "event",
        F.timestamp_millis("since").cast(kind).alias("since"),
        F.col("value").alias(value),
        F.col("limit").alias("limit"),
    )
