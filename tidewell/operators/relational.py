"""Relational operators beyond plain joins and groups: the best rows of each key, anti joins with nulls, totals over many groupings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of_each(left: DataFrame, right: DataFrame, on: str, order: list[Column], n: int, take: dict[str, str], outer: bool = False) -> DataFrame:
    """Every left row with the first ``n`` right rows of its key, as a lateral subquery with a limit gives them; ``outer`` keeps left rows without any.

    The subquery is decorrelated: rows are numbered within their key once, however many left rows ask. Spark applies the bound on the number
    before the shuffle as well, so a key that many rows share sends at most ``n`` of each task. ``order`` should be total.
    """
    best = right.where(F.col(on).isNotNull()).select(F.col(on).alias("key"), *[F.col(c).alias(f"v{k}") for k, c in enumerate(take)], F.row_number().over(Window.partitionBy(on).orderBy(*order)).alias("nth")).where(F.col("nth") <= n)
    joined = left.select(F.col(on).alias("key"), F.struct(*left.columns).alias("l")).join(best, "key", "left" if outer else "inner")
    return joined.select("l.*", *[F.col(f"v{k}").alias(name) for k, name in enumerate(take.values())], F.col("nth"))


def not_in(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """The left rows for which SQL's ``left_col NOT IN (SELECT right_col ...)`` is true.

    A null on the right makes it true of none; an empty right side makes it true of all, nulls too. Whether there is one is counted first;
    the rest is a plain anti join, which two large sides can shuffle, where a null-aware one would broadcast a side.
    """
    rows, known = right.agg(F.count("*"), F.count(right_col)).first()
    if not rows:
        return left
    if rows > known:
        return left.where(F.lit(False))
    return left.where(F.col(left_col).isNotNull()).join(right.select(F.col(right_col).alias(left_col)).distinct(), left_col, "left_anti").select(*left.columns)


def in_any(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """The left rows whose value the right side has, each once (a semi join)."""
    return left.join(right.select(F.col(right_col).alias(left_col)).distinct(), left_col, "left_semi").select(*left.columns)


def grouped_totals(rows: DataFrame, keys: list[str], sums: dict[str, str], sets: list[list[str]], count: str = "n") -> DataFrame:
    """Sums and a count for each of several groupings (each a list of some of ``keys``), with ``level``: a bit for each key that is summed over, the first key's the highest.

    Rows are grouped by all keys first, so that what is copied once for each grouping are partial sums and not rows; a grouping
    with few groups gets all it needs from map-side sums.
    """
    if unknown := {k for s in sets for k in s}.difference(keys):
        raise ValueError(f"no such keys: {', '.join(sorted(unknown))}")
    finest = rows.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()], F.count("*").alias(count))
    kinds = {f.name: f.dataType for f in finest.schema}
    grouped = finest.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    return grouped.agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in (*sums, count)], F.grouping_id(*keys).cast("long").alias("level"))


def cube_sets(keys: list[str]) -> list[list[str]]:
    """All groupings by some of the keys."""
    return [[k for i, k in enumerate(keys) if mask >> i & 1] for mask in range(1 << len(keys))]


def rollup_sets(keys: list[str]) -> list[list[str]]:
    """The groupings by the first keys, from all of them to none."""
    return [keys[:n] for n in range(len(keys), -1, -1)]
