"""Joins and totals along time, and the relational operators, against brute force: nulls, ties, a hot key, empty sides, clashing names."""

import bisect
import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewell.operators.relational import best_of_each, cube_sets, grouped_totals, in_any, not_in, rollup_sets
from tidewell.operators.timeline import _place, as_of_join, interval_join, moving_totals, running_totals, stretched

R = random.Random(11)
DAY = dt.datetime(2024, 1, 1)


def _at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def _rows(n, first):
    """(id, user, minutes): a third are one user's, some have no user or time, many share a time."""
    out = [(first + k, R.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]), R.randrange(0, 400)) for k in range(n)]
    return [*out, (first + n, None, 5), (first + n + 1, 1, None), (first + n + 2, None, None), (first + n + 3, 99, 7), out[0]]


LEFT, RIGHT = _rows(300, 0), _rows(200, 1000)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(i, u, _at(m), 1, "x") for i, u, m in LEFT], "id long, user long, ts timestamp, stretch int, key string")  # the last two clash


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(i, u, _at(m), 2) for i, u, m in RIGHT], "rid long, user long, at timestamp, time int")


@pytest.mark.parametrize("most_rows", [10**6, 20])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 30])
def test_as_of_join(left, right, most_rows, strict, within):
    out = as_of_join(left, right, "user", "ts", "at", {"rid": "found"}, strict, within and F.expr(f"INTERVAL {within} MINUTES"), most_rows)
    assert out.columns == ["id", "user", "ts", "stretch", "key", "found"]
    want = []
    for i, u, m in LEFT:
        fit = [] if u is None or m is None else [(t, r) for r, v, t in RIGHT if v == u and t is not None and (t < m if strict else t <= m)]
        best = max(fit, default=(None, None))
        want.append((i, u, _at(m), 1, "x", None if within and fit and best[0] < m - within else best[1]))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_as_of_join_of_empty_sides(left, right):
    assert as_of_join(left.limit(0), right, "user", "ts", "at", {"rid": "found"}).count() == 0
    assert {r.found for r in as_of_join(left, right.limit(0), "user", "ts", "at", {"rid": "found"}).collect()} == {None}


@pytest.mark.parametrize("bucket_rows", [10**6, 7])
def test_interval_join(left, right, bucket_rows):
    low, high = F.col("at") - F.expr("INTERVAL 3 MINUTES"), F.col("at") + F.make_dt_interval(mins=F.col("rid") % 60)
    out = interval_join(left, right, "user", "ts", low, high, {"rid": "found"}, bucket_rows)
    want = [(i, r) for i, u, m in LEFT for r, v, t in RIGHT if u is not None and u == v and m is not None and t is not None and t - 3 <= m <= t + r % 60]
    assert sorted((x.id, x.found) for x in out.collect()) == sorted(want) and len(want) > 500
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert interval_join(left.limit(0), right, "user", "ts", low, high, {"rid": "found"}).count() == interval_join(left, right.limit(0), "user", "ts", low, high, {"rid": "found"}).count() == 0


@pytest.mark.parametrize("most_rows", [10**6, 20])
def test_running_and_moving_totals(left, most_rows):
    rows = left.withColumn("paid", F.when(F.col("id") % 7 > 0, (F.col("id") % 11).cast("decimal(10,2)")))
    paid = lambda i: i % 11 if i % 7 else None
    sound = [(i, u, m) for i, u, m in LEFT if u is not None and m is not None]
    out = running_totals(rows.where("user is not null and ts is not null").dropDuplicates(["id"]), "user", ["ts", "id"], "paid", most_rows=most_rows)
    assert out.columns == [*rows.columns, "running"] or most_rows == 20 and sorted(out.columns) == sorted([*rows.columns, "running"])
    got, want = {r.id: r.running for r in out.collect()}, {}
    for i, u, m in set(sound):
        upto = [paid(j) for j, v, n in set(sound) if v == u and (n, j) <= (m, i) and paid(j) is not None]
        want[i] = sum(upto) if upto else None
    assert got == want
    daily = defaultdict(int)
    for i, u, m in sound:
        daily[u, m] += paid(i) or 0
    out = moving_totals(rows, "user", "ts", "paid", F.expr("INTERVAL 45 MINUTES"), most_rows)
    assert {(r.user, r.ts): (r.total, r.running, r.moving) for r in out.collect()} == {(u, _at(m)): (n, sum(x for (v, t), x in daily.items() if v == u and t <= m), sum(x for (v, t), x in daily.items() if v == u and m - 45 <= t <= m)) for (u, m), n in daily.items()}
    assert moving_totals(rows.limit(0), "user", "ts", "paid", F.expr("INTERVAL 45 MINUTES")).count() == 0


def test_a_hot_key_is_cut_and_others_are_not(left):
    told, cut = stretched(left, "user", "ts", 50)
    seen = defaultdict(set)
    for r in told.collect():
        seen[r.user].add(r._stretch)
    assert cut and len(seen[1]) > 30 and all(s == {0} for u, s in seen.items() if u != 1)


def test_best_of_each(left, right):
    want = []
    for i, u, m in LEFT:
        best = sorted(((-1 if t is None else -t, r) for r, v, t in set(RIGHT) if u is not None and v == u))[:3]
        want += [(i, r, n + 1) for n, (_, r) in enumerate(best)] or [(i, None, None)]
    order = [F.desc(F.coalesce(F.unix_timestamp("at"), F.lit(int(DAY.timestamp()) + 60))), F.col("rid")]
    out = best_of_each(left, right.dropDuplicates(["rid"]), "user", order, 3, {"rid": "found"}, outer=True)
    assert sorted(((r.id, r.found, r.nth) for r in out.collect()), key=str) == sorted(want, key=str)
    inner = best_of_each(left, right.dropDuplicates(["rid"]), "user", order, 3, {"rid": "found"})
    assert inner.count() == sum(f is not None for _, f, _ in want)


def test_not_in_with_and_without_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "k long, v string")
    for held in ([], [None], [2], [2, None], [5]):
        b = spark.createDataFrame([(h,) for h in held], "k long")
        a.createOrReplaceTempView("a_side")
        b.createOrReplaceTempView("b_side")
        want = spark.sql("SELECT * FROM a_side WHERE k NOT IN (SELECT k FROM b_side)")
        assert sorted(map(tuple, not_in(a, b, "k", "k").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert sorted(map(tuple, in_any(a, b, "k", "k").collect()), key=str) == sorted(map(tuple, spark.sql("SELECT * FROM a_side WHERE k IN (SELECT k FROM b_side)").collect()), key=str)


def test_grouped_totals(spark):
    rows = [(R.choice(["a", "b", None]), R.choice([1, 2, None]), R.choice(["x", "y"]), R.choice([1, 2, 3, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "p string, q long, r string, v long")
    keys = ["p", "q", "r"]
    for sets in (cube_sets(keys), rollup_sets(keys), [["p", "r"], []]):
        want = defaultdict(lambda: [None, 0])
        for s in sets:
            for row in rows:
                key = tuple(row[i] if k in s else None for i, k in enumerate(keys)) + (sum(4 >> i for i, k in enumerate(keys) if k not in s),)
                if row[3] is not None:
                    want[key][0] = (want[key][0] or 0) + row[3]
                want[key][1] += 1
        out = grouped_totals(df, keys, {"total": "v"}, sets)
        assert {(r.p, r.q, r.r, r.level): [r.total, r.n] for r in out.collect()} == dict(want)
    with pytest.raises(ValueError, match="no such keys"):
        grouped_totals(df, keys, {"total": "v"}, [["z"]])


def test_places_among_many_edges(spark):
    edges = sorted(R.sample(range(100_000), 5000))
    values = [0, 99_999, *edges[:3], *edges[-3:], *R.sample(range(100_000), 200)]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", _place(F.array(*[F.lit(e) for e in edges]), F.col("v"), len(edges)).alias("k")).collect()
    assert [(r.v, r.k) for r in got] == [(v, bisect.bisect_right(edges, v)) for v in values]
