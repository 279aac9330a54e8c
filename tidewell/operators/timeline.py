"""Joins and totals along time: as-of join, interval join, running and moving totals, each for a key that many rows may share.

A key that holds much of a table is cut into stretches of its time, at quantiles of a sketch; what a stretch hands on to later ones is
carried over by a table of at most STRETCHES rows for each such key. So no task has to hold a key's whole history, and rows of other keys stay in one
stretch. The cuts are found first and held as literals, so a retried task cuts at the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is cut if it has more rows than MOST_ROWS and more than one in SHARE of all; so fewer than SHARE keys are cut.
MOST_ROWS, SHARE = 1_000_000, 1000
STRETCHES = 64
#: Rows that a task sorts, about: more rows make more tasks, not larger ones.
TASK_ROWS = 250_000
#: Points that a bucket of an interval join holds, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 10_000


def stretched(rows: DataFrame, key: str, time: str, most_rows: int = MOST_ROWS) -> tuple[DataFrame, bool]:
    """``rows`` with their key's stretch of time as column ``_stretch``, and whether any key is cut. Null keys and times are never cut."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("m"))
    told = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.collect_list(F.when(F.col("m") > most_rows, F.struct("m", key)))).first()
    total, crowded = told[0], [r for r in told[1] if r.m * SHARE > told[0]]
    if not crowded:
        return _dealt(rows.withColumn("_stretch", F.lit(0)), total, key), False
    spark = rows.sparkSession
    keys = spark.createDataFrame([(r[key],) for r in crowded], sizes.select(key).schema)
    at = [F.lit(k / STRETCHES) for k in range(1, STRETCHES)]
    cuts = rows.join(F.broadcast(keys), key).groupBy(key).agg(F.percentile_approx(time, F.array(*at), 1000).alias("_cuts"))
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)  # fewer than SHARE rows
    told = rows.join(F.broadcast(cuts), key, "left")
    told = told.withColumn("_stretch", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(time))), F.lit(0)).cast("int")).withColumn("_stretch", F.greatest("_stretch", F.lit(0))).drop("_cuts")
    return _dealt(told, total, key, "_stretch"), True


def _dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to tasks of about TASK_ROWS of their ``total``; fewer are left to Spark."""
    return rows.repartition(-(-total // TASK_ROWS), *keys) if total > TASK_ROWS else rows


def as_of_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: dict[str, str], strict: bool = False, within: Column | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Every left row with columns of the latest right row of its key that is not later (``strict``: that is earlier).

    ``on`` is a column of both; ``take`` names right columns and what they are called in the result. Both sides are sorted once as one table, and the
    last right row is carried on. Of right rows at the same time, the one with the greatest taken values counts, in their order.
    ``within`` leaves out right rows that are further back. Rows without a key, a time or a match get nulls; left rows are never
    lost or doubled.
    """
    made = F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(take)], F.col(right_time).alias("at"))
    r = right.where(F.col(on).isNotNull() & F.col(right_time).isNotNull()).select(F.col(on).alias("key"), F.col(right_time).alias("time"), made.alias("r"))
    l_all = left.select(F.col(on).alias("key"), F.col(left_time).alias("time"), F.struct(*left.columns).alias("l"))
    sound = F.col("key").isNotNull() & F.col("time").isNotNull()
    l_type, r_type = l_all.schema["l"].dataType, r.schema["r"].dataType
    sides = (1, 0) if strict else (0, 1)  # what comes first at the same time
    both = r.select("key", "time", F.lit(sides[0]).alias("side"), F.lit(None).cast(l_type).alias("l"), "r").union(l_all.where(sound).select("key", "time", F.lit(sides[1]).alias("side"), "l", F.lit(None).cast(r_type).alias("r")))
    both, cut = stretched(both, "key", "time", most_rows)
    line = Window.partitionBy("key", "_stretch").orderBy("time", "side", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("last", F.last("r", ignorenulls=True).over(line))
    if cut:
        ends = both.groupBy("key", "_stretch").agg(F.max(F.when(F.col("r").isNotNull(), F.struct("time", "r"))).alias("e"))
        ends = ends.where(F.col("key").isin([k.key for k in ends.where("_stretch > 0").select("key").distinct().collect()]))  # only cut keys, fewer than SHARE
        earlier = Window.partitionBy("key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        before = ends.select("key", "_stretch", F.last("e.r", ignorenulls=True).over(earlier).alias("before"))
        carried = carried.join(F.broadcast(before), ["key", "_stretch"], "left").withColumn("last", F.coalesce("last", "before"))
    told = carried.where(F.col("l").isNotNull()).select("l", "time", "last").union(l_all.where(~sound).select("l", "time", F.lit(None).cast(r_type)))
    near = F.col("last.at") >= F.col("time") - within if within is not None else F.lit(True)
    return told.select("l.*", *[F.when(near, F.col(f"last.v{k}")).alias(name) for k, name in enumerate(take.values())])


def interval_join(points: DataFrame, intervals: DataFrame, on: str, point: str, low: Column, high: Column, take: dict[str, str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every pair of a point and an interval of the same key that holds it, both ends included: the point's columns and ``take`` of the interval.

    Time is cut into buckets of about as many points, at quantiles of a sketch. A point is in one bucket, an interval in all that it
    meets, so the pairs come from an equality join by key and bucket, with an exact check; an interval that spans many buckets holds
    their points, if its key has any. A key that holds most points is spread over the buckets. Nulls match nothing.
    """
    sound = points.where(F.col(on).isNotNull() & F.col(point).isNotNull())
    n = sound.count()
    buckets = min(MOST_BUCKETS, -(-n // bucket_rows)) or 1
    cuts = []
    if buckets > 1:
        cuts = sorted(set(sound.agg(F.percentile_approx(point, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 10 * buckets).alias("c")).first().c))
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast(f"array<{points.schema[point].dataType.simpleString()}>")
    of = lambda c: _place(edges, c, len(cuts))
    spans = intervals.select(F.col(on).alias("key"), low.alias("low"), high.alias("high"), F.struct(*[F.col(c).alias(f"v{k}") for k, c in enumerate(take)]).alias("i"))
    spans = spans.where("key is not null and low <= high").withColumn("bucket", F.explode(F.sequence(of(F.col("low")), of(F.col("high")))))
    dealt = sound.select(F.col(on).alias("key"), F.col(point).alias("point"), F.struct(*points.columns).alias("p"), of(F.col(point)).alias("bucket"))
    met = dealt.join(spans, ["key", "bucket"]).where("point >= low and point <= high")
    return met.select("p.*", *[F.col(f"i.v{k}").alias(name) for k, name in enumerate(take.values())])


def _place(edges: Column, value: Column, n: int) -> Column:
    """How many of the ``n`` sorted edges are not above a value, by halving."""
    if not n:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: low + F.when((low + step <= n) & (F.get(edges, low + step - 1) <= value), step).otherwise(F.lit(0)))


def running_totals(rows: DataFrame, on: str, order: list[str], value: str, name: str = "running", most_rows: int = MOST_ROWS) -> DataFrame:
    """``rows`` with the total of ``value`` of all rows of their key up to each, in ``order``, whose first column is cut into stretches.

    A null value counts for nothing (a total of none is null); rows that agree in all of ``order`` are taken in any order.
    """
    told, cut = stretched(rows, on, order[0], most_rows)
    line = Window.partitionBy(on, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = told.withColumn(name, F.sum(value).over(line))
    if cut:
        sums = told.groupBy(on, "_stretch").agg(F.sum(value).alias("sum"))
        sums = sums.where(F.col(on).isin([k[0] for k in sums.where("_stretch > 0").select(on).distinct().collect()]))  # only cut keys, fewer than SHARE
        earlier = Window.partitionBy(on).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(on, "_stretch", F.sum("sum").over(earlier).alias("_before"))
        joined = out.join(F.broadcast(before), [on, "_stretch"], "left")
        kind = out.schema[name].dataType
        out = joined.withColumn(name, F.when(F.col(name).isNull(), F.col("_before")).otherwise(F.col(name) + F.coalesce("_before", F.lit(0))).cast(kind)).drop("_before")
    return out.drop("_stretch")


def moving_totals(rows: DataFrame, on: str, time: str, value: str, span: Column, most_rows: int = MOST_ROWS) -> DataFrame:
    """(key, time, total, running, moving) of each different time of a key: its total, that of all times up to it, and that of the times in [time - span, time].

    A moving total is a running one less that just before its window, found by an as-of join. So it costs the same for every span.
    ``value`` should be exact (an integer or a decimal); a null counts as 0. Rows without a key or a time are left out.
    """
    daily = rows.where(F.col(on).isNotNull() & F.col(time).isNotNull()).groupBy(on, time).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"))
    sums = running_totals(daily, on, [time], "total", "running", most_rows)
    asked = sums.withColumn("since", F.col(time) - span)
    told = as_of_join(asked, sums, on, "since", time, {"running": "before"}, strict=True, most_rows=most_rows)
    return told.select(on, time, "total", "running", (F.col("running") - F.coalesce("before", F.lit(0))).cast(sums.schema["running"].dataType).alias("moving"))
