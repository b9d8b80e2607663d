"""Streams against batches: late rows, copies, restarts, sessions of a hot user."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from souk.sources.tpch import RAW_SCHEMAS
from souk.streaming import activity

SCHEMA = RAW_SCHEMAS["events"]
T0 = datetime(2024, 1, 1)


def log(seed, n=600, hours=72):
    """Events in the order of their times; one user has a third of them, some have no value or user."""
    rnd = random.Random(seed)
    times = sorted(rnd.uniform(0, hours * 60) for _ in range(n))
    return [(i, T0 + timedelta(minutes=round(m)), rnd.choice([1, 1, 1, 2, 3, 4, 5, None]), rnd.choice(["view", "click", None]),
             rnd.choice([None, round(rnd.uniform(0, 50), 2)])) for i, m in enumerate(times)]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("make", [activity.event_windows, activity.event_sessions])
def test_stream_equals_batch(spark, tmp_path, make):
    """Files in turn, each with rows late by less than an hour and copies of earlier rows; the
    stream stops after each file and goes on from its checkpoint."""
    rows, late = log(1), timedelta(hours=1)
    parts = [rows[i:i + 100] for i in range(0, len(rows), 100)]
    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    rnd = random.Random(2)
    held = []
    for part in parts:
        now = part[-1][1]
        moved = [r for r in part if rnd.random() < 0.2 and now - r[1] < late / 2]  # come with the next file
        copies = [r for r in part if rnd.random() < 0.1 and now - r[1] < late / 2]
        write(spark, [r for r in part if r not in moved] + held, src)
        held = moved + copies
        got = activity.run_available(make(activity.read_stream(spark, src, SCHEMA, 1)), out, state)
    end = "window_end" if make is activity.event_windows else "session_end"
    last = max(r[1] for r in rows if r not in held)
    batch = make(spark.createDataFrame(rows, SCHEMA))
    closed = batch.where(F.col(end) <= F.lit(last - late).cast("timestamp_ntz"))
    assert rows_of(got) == rows_of(closed) and got.count() > 10
    # Nothing new: nothing is written again.
    again = activity.run_available(make(activity.read_stream(spark, src, SCHEMA, 1)), out, state)
    assert rows_of(again) == rows_of(closed)


def test_too_late_rows_are_dropped(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    minute = lambda m: T0 + timedelta(minutes=m)
    for part in ([(1, minute(10), 1, "view", 1.0), (2, minute(2000), 1, "view", 1.0)],
                 [(3, minute(20), 1, "view", 1.0), (4, minute(1990), 1, "view", 1.0)], [(5, minute(9000), 1, "view", 1.0)]):
        write(spark, part, src)
        got = activity.run_available(activity.event_windows(activity.read_stream(spark, src, SCHEMA)), out, state)
    assert sorted((r["window_start"], r["events"]) for r in got.collect()) == [(minute(0), 1), (minute(1800), 2)]


def test_sliding_windows_hold_each_event_as_often_as_they_overlap(spark):
    rows = [r for r in log(3) if r[3]]
    got = activity.event_windows(spark.createDataFrame(rows, SCHEMA), "6 hours", slide="2 hours")
    assert got.agg(F.sum("events")).first()[0] == 3 * len(rows)


@pytest.mark.parametrize("gap", ["2 hours", "7 minutes", "30 hours"])
def test_merged_sessions(spark, gap):
    """Sessions over midnight, over several days, and events exactly one gap apart."""
    rows = log(4) + log(4)[:50] + [(9000, None, 1, "view", 1.0)]
    rows += [(5000 + i, T0 + timedelta(hours=200 + 2 * i), 9, "view", 1.0) for i in range(5)]
    rows += [(6000 + i, T0 + timedelta(hours=300, minutes=119 * i), 9, "view", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(activity.merged_sessions(df, gap)) == rows_of(activity.event_sessions(df, gap))


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert activity.merged_sessions(none).count() == activity.event_windows(none).count() == activity.session_summary(none).count() == 0
