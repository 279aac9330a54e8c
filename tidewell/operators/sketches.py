"""Quantiles and distinct counts from stored sketches: each part of a table is summed up once, and answers over many parts merge what is stored.

Quantiles are KLL sketches, distinct counts theta sketches, both of bounded size whatever the rows. A theta sketch is exact up to 2**LOG_NOMINAL different
values and has a standard error of about 1 / sqrt(2**LOG_NOMINAL) beyond; the rank of a KLL quantile is off by about 0.013 at most of times with K = 200,
and merging doesn't add to either. Nulls are not counted; a part without values has null sketches and counts for nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, LOG_NOMINAL = 200, 12
#: What a quantile's rank may be off by in tests and reports: a little over twice the stated error of one quantile.
RANK_ERROR = 0.03


def sketched(rows: DataFrame, keys: list[str], value: str, item: str, k: int = K, log_nominal: int = LOG_NOMINAL) -> DataFrame:
    """(keys, n, quantiles, distinct): the rows of each key, a KLL sketch of ``value`` and a theta sketch of ``item``."""
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count(number) > 0, F.kll_sketch_agg_double(number, k)).alias("quantiles"), F.theta_sketch_agg(F.col(item), log_nominal).alias("distinct"))


def merged_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of parts that agree in ``keys``, as one. Parts are merged in two steps, so that a key with very many of them is no task's alone."""

    def step(rows: DataFrame, by: list[str]) -> DataFrame:
        lists = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.collect_list("quantiles").alias("q"), F.theta_union_agg("distinct", F.lit(LOG_NOMINAL)).alias("distinct"))
        return lists.select(*by, "n", F.when(F.size("q") > 0, F.reduce(F.slice("q", 2, F.greatest(F.size("q") - 1, F.lit(0))), F.get("q", F.lit(0)), F.kll_sketch_merge_double)).alias("quantiles"), "distinct")

    lot = F.pmod(F.xxhash64("quantiles"), F.lit(32)).alias("_lot")
    return step(step(parts.select("*", lot), [*keys, "_lot"]), keys)


def answers(sketches: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys, n, distinct, q): the estimates of each key's sketches, ``q`` an array of the values at these ranks."""
    at = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(x))) for x in quantiles])
    return sketches.select(*keys, "n", F.theta_sketch_estimate("distinct").alias("distinct"), F.when(F.col("quantiles").isNotNull(), at).alias("q"))


def exact_counts(told: DataFrame, rows: DataFrame, keys: list[str], item: str, log_nominal: int = LOG_NOMINAL) -> DataFrame:
    """``told`` (keys, distinct, ...) with the exact number of different items in place of the estimates that may be off.

    A sketch of fewer than 2**log_nominal items is exact; half of that leaves room for an estimate's error. Items of the other keys are counted from
    ``rows``, each of a key's different ones once and spread over all tasks.
    """
    over = told.where(F.col("distinct") * 2 > 2**log_nominal).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    met = rows.where(F.col(item).isNotNull()).select(*keys, item).join(over, same, "left_semi").distinct()
    counted = met.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_exact"))
    return told.join(counted, same, "left").withColumn("distinct", F.coalesce("_exact", F.round("distinct").cast("long"))).select(*told.columns)
