"""Breach events against a plain loop, over restarts, late and disordered rows."""

import datetime
import itertools
import random

import pytest

from tabprep.streaming.alerts import breach_events, turned
from tabprep.streaming.score import to_parquet

START = datetime.datetime(2024, 1, 1)
SCHEMA = "window_start timestamp_ntz, d_id bigint, tag string, tag_value double, tag_c_value double"


def row(hour, key, value, limit=1.0, tag="t"):
    return START + datetime.timedelta(hours=hour), key, tag, value, limit


def run(spark, home, batches, watermark="2 hours", **more):
    """Every batch is one run of the stream that goes on where the one before stopped."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{home}/in")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{home}/in")
        to_parquet(breach_events(arriving, watermark, **more), f"{home}/out", f"{home}/state").awaitTermination()
    found = spark.read.parquet(f"{home}/out").orderBy("d_id", "window_start").collect()
    return [(r.d_id, int((r.window_start - START).total_seconds() // 3600), r.event, int((r.since - START).total_seconds() // 3600)) for r in found]


def plain(rows, last, raise_after=1, clear_after=1):
    """Events of all rows before hour `last`."""
    out = []
    for key in sorted({r[1] for r in rows}):
        raised, run = False, []
        for at, _, _, value, limit in sorted(r for r in rows if r[1] == key):
            hour = int((at - START).total_seconds() // 3600)
            if hour >= last:
                continue
            run = [*run, hour] if (value > limit) != raised else []
            if len(run) == (clear_after if raised else raise_after):
                raised = not raised
                out.append((key, hour, "raised" if raised else "cleared", run[0]))
                run = []
    return out


def test_restart_neither_repeats_nor_forgets(spark, tmp_path):
    first = [row(0, 1, 0.5), row(1, 1, 2.0), row(2, 1, 2.0), row(9, 2, 0.0)]  # raised in hour 1
    second = [row(10, 1, 3.0), row(11, 1, 0.1), row(20, 2, 5.0)]  # still raised, then cleared
    third = [row(21, 1, 0.2), row(22, 1, 9.0), row(40, 2, 0.0)]
    found = run(spark, tmp_path, [first, second, third])
    assert found == [(1, 1, "raised", 1), (1, 11, "cleared", 11), (1, 22, "raised", 22), (2, 20, "raised", 20)]


@pytest.mark.parametrize("runs", [(1, 1), (3, 2)])
def test_disorder_against_a_loop(spark, tmp_path, runs):
    rng = random.Random(runs[0])
    rows = [row(h, k, rng.choice([0.0, 2.0]), 1.0) for h in range(60) for k in (1, 2, 3)]
    arriving = sorted(rows, key=lambda r: (r[0] + datetime.timedelta(hours=rng.uniform(0, 5)), r[1]))  # up to five hours late
    batches = [arriving[i : i + 45] for i in range(0, len(arriving), 45)]
    more = dict(zip(("raise_after", "clear_after"), runs))
    assert run(spark, tmp_path, batches, "6 hours", **more) == plain(rows, 59 - 6, **more)


def test_gaps_and_nulls(spark, tmp_path):
    rows = [row(0, None, 2.0), row(1, None, None), row(2, None, 3.0), row(3, None, 0.0), row(4, 7, 2.0, None), row(30, 7, 0.0)]
    assert run(spark, tmp_path, [rows]) == [(None, 0, "raised", 0), (None, 3, "cleared", 3)]
    with pytest.raises(ValueError):
        breach_events(spark.createDataFrame(rows, SCHEMA), "1 hour", raise_after=0)


def test_turned_counts_runs():
    for values in itertools.product((0.0, 2.0), repeat=6):
        rows = [(i, v, 1.0) for i, v in enumerate(values)]
        whole = list(turned(rows, False, 0, 0, 2, 2))
        head = list(turned(rows[:3], False, 0, 0, 2, 2))
        tail = list(turned(rows[3:], *head[-1][:3], 2, 2))
        assert head + tail == whole  # the state is all that must be kept
