"""Streams against batches over the same rows: several runs, late rows, nulls, ties, and a restart from the checkpoint."""

import datetime as dt
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.streaming.events import OpenSessions, event_stream, latest, run_sessions, run_windows, session_stream, sessions_of, windowed

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DAY = dt.datetime(2024, 3, 1)


def _events(r, n, first, last):
    """Events between two minutes, a third of them one user's; some lack a time, a user or a value."""
    out = []
    for k in range(n):
        at = DAY + dt.timedelta(minutes=r.uniform(first, last)) if r.random() > 0.03 else None
        out.append((k, at, r.choice([1, 1, 2, 3, 4, None]), r.choice(["a", "b", None]), r.choice([1.25, 2.5, None, -3.1]), "{}"))
    return [*out, *out[:3]]


@pytest.fixture
def feed(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return put, str(tmp_path / "in"), str(tmp_path / "out")


@pytest.mark.parametrize("slide", [None, "10 minutes"])
def test_windows_equal_a_batch_after_every_run(spark, feed, slide):
    put, source, folder = feed
    r = random.Random(2)
    put(_events(r, 80, 0, 300))
    for step in range(3):
        stream = windowed(event_stream(spark, source, 1), "30 minutes", slide, "2 hours")
        run_windows(stream, folder)
        want = windowed(spark.read.parquet(source), "30 minutes", slide)
        assert Counter(map(tuple, latest(spark, folder, ["start", "event_type"]).collect())) == Counter(map(tuple, want.collect()))
        put(_events(r, 60, 200 + 250 * step, 500 + 250 * step))  # out of order, but not late
    before = spark.read.parquet(f"{folder}/changes").count()
    run_windows(windowed(event_stream(spark, source, 1), "30 minutes", slide, "2 hours"), folder)
    run_windows(windowed(event_stream(spark, source, 1), "30 minutes", slide, "2 hours"), folder)  # nothing new: nothing doubled
    assert spark.read.parquet(f"{folder}/changes").count() >= before
    want = windowed(spark.read.parquet(source), "30 minutes", slide)
    assert Counter(map(tuple, latest(spark, folder, ["start", "event_type"]).collect())) == Counter(map(tuple, want.collect()))


def test_late_events_are_left_out(spark, feed):
    put, source, folder = feed
    at = lambda m: DAY + dt.timedelta(minutes=m)
    put([(1, at(5), 1, "a", 1.0, ""), (2, at(600), 1, "a", 1.0, "")])
    run = lambda: run_windows(windowed(event_stream(spark, source, 1), "30 minutes", delay="1 hour"), folder)
    run()
    put([(3, at(6), 1, "a", 1.0, ""), (4, at(545), 1, "a", 1.0, ""), (5, at(601), 1, "a", 1.0, "")])  # the first is later than the watermark allows
    run()
    got = {r.start: r.n for r in latest(spark, folder, ["start", "event_type"]).collect()}
    assert got == {at(0): 1, at(540): 1, at(600): 2}


def test_sessions_are_told_once_and_go_on_after_a_restart(spark, feed):
    put, source, folder = feed
    r = random.Random(7)
    gap = 600
    run = lambda: run_sessions(session_stream(event_stream(spark, source, 1), gap, "30 minutes"), folder)
    put(_events(r, 120, 0, 240))
    run()
    put(_events(r, 120, 230, 480))
    put(_events(r, 40, 470, 700))
    run()
    run()
    rows = spark.read.parquet(source)
    mark = rows.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=30)
    want = [tuple(s) for s in sessions_of(rows, gap).collect() if s["last"] + dt.timedelta(seconds=gap) < mark]
    got = [tuple(s) for s in spark.read.parquet(f"{folder}/sessions").collect()]
    assert Counter(got) == Counter(want) and len(want) > 20
    put([(9, DAY + dt.timedelta(days=3), 99, "a", None, "")])  # a later event closes all the others
    run()
    every = [tuple(s) for s in sessions_of(rows, gap).collect()]
    assert Counter(tuple(s) for s in spark.read.parquet(f"{folder}/sessions").collect()) == Counter(every)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=25), st.integers(0, 6), st.integers(0, 70))
def test_open_sessions_in_any_order(times, gap, watermark):
    held = OpenSessions(None, gap)
    for t in times:
        held.add(t, 2 * t)
    want = []
    for t in sorted(times):
        if want and t - want[-1][1] <= gap:
            s = want[-1]
            want[-1] = (s[0], t, s[2] + 1, s[3] + 2 * t)
        else:
            want.append((t, t, 1, 2 * t))
    closed = held.closed(watermark)
    assert closed == [s for s in want if s[1] + gap < watermark]
    assert list(zip(held.start, held.end, held.n, held.total, strict=True)) == [s for s in want if s[1] + gap >= watermark]
