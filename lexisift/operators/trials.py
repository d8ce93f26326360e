"""Verdicts over repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(df: DataFrame, keys: list[str], value: Column, good: Column, target: int | Column, extra: list[Column]) -> DataFrame:
    n, k = F.count(value), F.sum(F.when(good, 1).otherwise(0)).cast("long")
    target = F.lit(target) if isinstance(target, int) else F.max(target)
    out = df.groupBy(*keys).agg(n.alias("n_success"), (F.count(F.lit(1)) - n).alias("n_fail"), k.alias("k"), target.alias("_target"), *extra)
    out = out.withColumn("inconclusive", F.col("n_success") < F.ceil(F.col("_target") / 2)).drop("_target")
    return out.withColumn("passed_fraction", F.concat(F.col("k"), F.lit("/"), F.col("n_success")))


def continuous(df: DataFrame, keys: list[str], value: str, threshold: float, target: int) -> DataFrame:
    """A row for each case: median of the runs, whether it is at most ``threshold``, flaky if the runs lie on both sides.

    A null value is a failed run and counts for nothing else. With fewer than half of ``target``
    successes the case is inconclusive and its verdict null. Cases without rows have no row.
    """
    v = F.col(value)
    out = _runs(df, keys, v, v <= threshold, target, [F.round(F.median(v), 4).alias("median"), F.min(v).alias("_min"), F.max(v).alias("_max")])
    verdict = F.when(~F.col("inconclusive"), F.col("median") <= threshold)
    flaky = ~F.col("inconclusive") & F.coalesce((F.col("_min") <= threshold) & (F.col("_max") > threshold), F.lit(False))
    return out.withColumn("verdict", verdict).withColumn("flaky", flaky).drop("_min", "_max")


def binary(df: DataFrame, keys: list[str], value: str, target: int) -> DataFrame:
    """A row for each case: share of runs with value 1; an even split passes. Nulls as in ``continuous``."""
    v = F.col(value)
    out = _runs(df, keys, v, v == 1, target, [])
    out = out.withColumn("fraction", F.when(F.col("n_success") > 0, F.round(F.col("k") / F.col("n_success"), 4)))
    verdict = F.when(~F.col("inconclusive"), (F.col("n_success") > 0) & (F.col("k") >= F.ceil(F.col("n_success") / 2)))
    return out.withColumn("verdict", verdict).withColumn("flaky", ~F.col("inconclusive") & (F.col("k") > 0) & (F.col("k") < F.col("n_success")))


def scores(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, sample deviation (0 under two runs) and median of each score column, rounded to three digits."""
    aggs = []
    for c in columns:
        aggs += [F.round(F.avg(c), 3).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 3).alias(f"{c}_stdev"), F.round(F.median(c), 3).alias(f"{c}_median")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *aggs)
