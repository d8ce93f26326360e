"""N-grams that tell two corpora apart, by signed log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisift.functions import text as T


def llr(a: Column, b: Column, total_a: Column, total_b: Column) -> Column:
    """Signed ratio of counts ``a`` and ``b`` in corpora of so many tokens; positive if ``a`` is over-used."""
    n = total_a + total_b
    ea, eb = (a + b) * total_a / n, (a + b) * total_b / n
    one = 2.0 * a * F.log(a / ea)
    both = 2.0 * (a * F.log(a / ea) + b * F.log(b / eb))
    sign = F.when(a / total_a >= F.when(total_b > 0, b / total_b).otherwise(F.lit(0.0)), 1.0).otherwise(-1.0)
    return F.when((n == 0) | (a == 0) | (ea <= 0), F.lit(0.0)).otherwise(sign * F.when((b == 0) | (eb <= 0), one).otherwise(both))


def gram_counts(df: DataFrame, text: str, flag: Column, min_n: int, max_n: int) -> DataFrame:
    """``ngram, n, a, b``: counts of n-grams in the rows where ``flag`` holds and in the others.

    One aggregation for both sides and all orders; it combines before its shuffle. N-grams do not
    cross the border of a document.
    """
    toks = df.select(T.tokens(F.col(text)).alias("t"), flag.alias("is_a"))

    def grams_of(n: int) -> Column:
        return F.transform(T.ngrams(F.col("t"), n), lambda g: F.struct(g.alias("ngram"), F.lit(n).alias("n")))

    grams = F.concat(*map(grams_of, range(min_n, max_n + 1)))
    long = toks.select("is_a", F.explode(grams).alias("g"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return long.groupBy("g.ngram", "g.n").agg(one(F.col("is_a")).alias("a"), one(~F.col("is_a")).alias("b"))


def totals(df: DataFrame, text: str, flag: Column) -> DataFrame:
    """One row ``total_a, total_b``: tokens of both sides."""
    n = F.size(T.tokens(F.coalesce(F.col(text), F.lit(""))))
    return df.select(F.sum(F.when(flag, n).otherwise(0)).cast("long").alias("total_a"), F.sum(F.when(~flag, n).otherwise(0)).cast("long").alias("total_b"))


def mine(df: DataFrame, text: str, flag: Column, min_n: int = 2, max_n: int = 4, min_count: int = 3, top_k: int = 50, digits: int = 6) -> DataFrame:
    """``rank, ngram, n, ai_count, human_count, ai_freq_ppm, human_freq_ppm, llr`` of the ``top_k`` n-grams of the flagged side.

    Only n-grams with ``min_count`` flagged occurrences are scored. Ties of the rounded ratio go
    to the larger count, then the shorter and alphabetically first n-gram. Rows with a null flag
    or text are left out; empty corpora give no rows.
    """
    known = df.filter(F.col(text).isNotNull() & flag.isNotNull())
    sums = totals(known, text, flag).first()
    ta, tb = (F.lit(int(x or 0)) for x in sums)
    counts = gram_counts(known, text, flag, min_n, max_n).filter(F.col("a") >= min_count)
    ppm = lambda c, t: F.round(c / F.when(t > 0, t / F.lit(1e6)).otherwise(F.lit(1.0)), 2)
    scored = counts.select(
        "ngram", "n", F.col("a").alias("ai_count"), F.col("b").alias("human_count"),
        ppm(F.col("a"), ta).alias("ai_freq_ppm"), ppm(F.col("b"), tb).alias("human_freq_ppm"), F.round(llr(F.col("a"), F.col("b"), ta, tb), digits).alias("llr"),
    )
    order = [F.desc("llr"), F.desc("ai_count"), F.asc("n"), F.asc("ngram")]
    top = scored.orderBy(*order).limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
