"""Summaries of repeated runs: detection by case and pattern, over-editing by file, first attempts.

A run is a row; a null value is a failed run. Lists of cases are given as rows with a mark, not as
arrays, so that no summary row grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.operators import rewrite, trials


def _one(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def _rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """Rounded share; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def case_verdicts(runs: DataFrame, keys: list[str], target: int, threshold: float = 0.10) -> DataFrame:
    """A row for each case of ``runs`` (``keys``, ``status, detected, ratio, terms_present, terms_removed``).

    A scorable case is detected if at least half of its successful runs are; a true negative passes if the
    median of ``ratio`` is at most ``threshold``; what can't be scored has no verdict and is never
    inconclusive. A run with a null ``detected`` (or, of a true negative, a null ``ratio``) failed. Terms are the runs' medians,
    rounded half to even.
    """
    negative, scorable = F.col("status") == "true_negative", F.col("status") == "scorable"
    value = F.when(scorable, F.col("detected").cast("int").cast("double")).when(negative, F.when(F.col("ratio").isNotNull(), (F.col("ratio") <= threshold).cast("double")))
    rows = runs.withColumn("_value", value).withColumn("_ratio", F.when(negative, F.col("ratio")))
    there = F.when(F.col("_value").isNotNull() & scorable, F.col("terms_present"))
    gone = F.when(F.col("_value").isNotNull() & scorable, F.col("terms_removed"))
    ok = F.col("n_success")
    out = rows.groupBy(*keys, "status").agg(
        F.count("_value").alias("n_success"), (F.count(F.lit(1)) - F.count("_value")).alias("n_fail"), _one(F.col("_value") == 1).alias("k"), F.round(F.median("_ratio"), 4).alias("median_ratio"),
        F.coalesce(F.bround(F.median(there)), F.lit(0)).cast("long").alias("terms_present"), F.coalesce(F.bround(F.median(gone)), F.lit(0)).cast("long").alias("terms_removed"),
    )
    judged = F.col("status").isin("scorable", "true_negative")
    out = out.withColumn("inconclusive", judged & (ok < F.ceil(F.lit(target) / 2)))
    half = F.when(F.col("status") == "true_negative", F.col("median_ratio") <= threshold).otherwise(F.col("k") >= F.ceil(ok / 2))
    out = out.withColumn("verdict", F.when(judged & ~F.col("inconclusive"), (ok > 0) & half)).withColumn("fraction", F.when(judged & (ok > 0), F.round(F.col("k") / ok, 4)))
    return out.withColumn("flaky", judged & ~F.col("inconclusive") & (F.col("k") > 0) & (F.col("k") < ok))


def pattern_details(cases: DataFrame, threshold: float = 0.85) -> DataFrame:
    """A row for each pattern of ``case_verdicts``; inconclusive cases count neither as cases nor as misses."""
    sure = ~F.col("inconclusive")
    scored, negative = sure & (F.col("status") == "scorable"), sure & (F.col("status") == "true_negative")
    good = F.coalesce("verdict", F.lit(False))
    out = cases.groupBy("pattern_id").agg(
        _one(scored & good).alias("detected"), _one(scored).alias("total"), _one(F.col("status").startswith("unscorable")).alias("unscorable"),
        _one(negative).alias("true_negatives"), _one(negative & good).alias("true_negative_passes"), _one(~sure).alias("inconclusive"), _one(F.col("flaky")).alias("flaky"),
    )
    rate = F.col("detected") / F.col("total")
    return out.withColumn("rate", _rate(F.col("detected"), F.col("total"))).withColumn("below", (F.col("total") > 0) & F.coalesce(rate < threshold, F.lit(False)))


def pattern_marks(cases: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, mark``: missed cases, true negatives that were edited, inconclusive and flaky cases."""
    bad = ~F.col("inconclusive") & ~F.coalesce("verdict", F.lit(False))
    marks = F.array(
        F.when(bad & (F.col("status") == "scorable"), "miss"), F.when(bad & (F.col("status") == "true_negative"), "true_negative_failure"),
        F.when(F.col("inconclusive"), "inconclusive"), F.when(F.col("flaky"), "flaky"),
    )
    return cases.select(*keys, F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("mark"))


def pattern_summary(cases: DataFrame) -> DataFrame:
    """One row over all ``case_verdicts``: detection rate, mean of the cases' run fractions, rate of removed terms, counts.

    The detection rate asks for all terms of a case, the rate of terms counts each; rates of nothing are 0.
    """
    scored = ~F.col("inconclusive") & (F.col("status") == "scorable")
    good = F.coalesce("verdict", F.lit(False))
    out = cases.agg(
        F.count(F.lit(1)).alias("cases"), _one(scored).alias("scored"), _one(scored & good).alias("detected"), _one(F.col("status").startswith("unscorable")).alias("unscorable"),
        _one(F.col("inconclusive")).alias("inconclusive"), _one(F.col("flaky")).alias("flaky"), F.coalesce(F.round(F.avg(F.when(scored, F.col("fraction"))), 3), F.lit(0.0)).alias("mean_fraction"),
        F.coalesce(F.sum(F.when(scored, F.col("terms_present"))), F.lit(0)).alias("terms_present"), F.coalesce(F.sum(F.when(scored, F.col("terms_removed"))), F.lit(0)).alias("terms_removed"),
    )
    out = out.withColumn("detection_rate", _rate(F.col("detected"), F.col("scored"))).withColumn("term_rate", _rate(F.col("terms_removed"), F.col("terms_present")))
    return out.withColumn("complete", F.coalesce(F.col("inconclusive") == 0, F.lit(True)))


def overedit_files(runs: DataFrame, key: str, run: str, ratio: str, preflight: str, length: str, target: int, threshold: float = 0.10) -> DataFrame:
    """A row for each file: ``trials.continuous`` with the share of quick drops and the first successful run's facts.

    ``above`` tells whether the median exceeds ``threshold`` (never without a successful run), ``quick_drop`` whether
    at least half of the successful runs dropped to the quick mode; ``preflight`` and
    ``length`` are those of the first successful run, 0 and empty without one.
    """
    rows = runs.select(F.col(key).alias(key), F.col(run).alias("_run"), F.col(ratio).alias("_ratio"), F.coalesce(preflight, F.lit("")).alias("_pre"), F.col(length).cast("long").alias("_length"))
    ok = F.col("_ratio").isNotNull()
    verdicts = trials.continuous(rows.withColumnRenamed("_ratio", "ratio"), [key], "ratio", threshold, target)
    first = F.min(F.when(ok, F.struct("_run", "_ratio", "_pre", "_length")))
    facts = rows.groupBy(F.col(key).alias("_key")).agg(_one(ok & rewrite.quick_drop(F.col("_pre"))).alias("_quick"), first.alias("_first"))
    out = verdicts.join(facts, F.col(key).eqNullSafe(F.col("_key")))
    some = F.col("n_success") > 0
    return out.select(
        key, "n_success", "n_fail", "median", "inconclusive", "flaky", F.coalesce(F.col("median") > threshold, F.lit(False)).alias("above"), (some & (F.col("_quick") >= F.ceil(F.col("n_success") / 2))).alias("quick_drop"),
        F.coalesce("_first._pre", F.lit("")).alias("preflight"), F.coalesce("_first._length", F.lit(0)).alias("length"),
    )


def overedit_summary(files: DataFrame) -> DataFrame:
    """One row over ``overedit_files``: mean of the medians, files above the threshold, quick drops and their rates, of files that are conclusive."""
    sure = ~F.col("inconclusive")
    out = files.agg(
        _one(sure).alias("files"), F.coalesce(F.round(F.avg(F.when(sure, F.col("median"))), 4), F.lit(0.0)).alias("mean_ratio"), _one(sure & F.col("above")).alias("above"),
        _one(sure & F.col("quick_drop")).alias("quick_drops"), _one(~sure).alias("inconclusive"), _one(F.col("flaky")).alias("flaky"),
    )
    return out.withColumn("above_rate", _rate(F.col("above"), F.col("files"))).withColumn("quick_drop_rate", _rate(F.col("quick_drops"), F.col("files")))


def first_attempt_rate(runs: DataFrame, flag: str) -> DataFrame:
    """One row ``runs, flagged, rate``: of the runs that say so, those whose first attempt was a change log."""
    said = F.col(flag).isNotNull()
    out = runs.agg(_one(said).alias("runs"), _one(said & F.col(flag)).alias("flagged"))
    return out.withColumn("rate", _rate(F.coalesce("flagged", F.lit(0)), F.coalesce("runs", F.lit(0))))
