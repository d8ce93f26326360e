"""Rule hits, density, bands, paragraphs, dimensions and rhythm of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.lexicon import DIMENSIONS, UNIVERSAL, Rule, pack


def hits_of(c: Column, rule: Rule) -> Column:
    return T.count(c, rule.java)


def hits_map(c: Column, lang: str = "en", only: Column | None = None) -> Column:
    """Map of rule to hits for every rule of the pack; where ``only`` holds, rules of form alone count."""
    pairs = []
    for r in pack(lang):
        h = hits_of(c, r)
        pairs += [F.lit(r.key), h if only is None or r.key in UNIVERSAL else F.when(only, F.lit(0).cast("long")).otherwise(h)]
    return F.create_map(*pairs)


def tier1(hits: Column, words: Column, lang: str = "en") -> Column:
    """Sum of all hits, without those of rules that stay at or under their threshold density."""
    parts = []
    for r in pack(lang):
        h = hits[r.key]
        parts.append(h if r.threshold is None else F.when(T.density(h, words) > r.threshold, h).otherwise(F.lit(0).cast("long")))
    return sum(parts[1:], parts[0])


def score(df: DataFrame, text: str, lang: str = "en") -> DataFrame:
    """``df`` with ``words, hits, tier1, density, band`` of ``text`` without code and quotations.

    A null text scores as an empty one. All rules are counted in one narrow pass; ``hits`` is a map,
    which later steps read without scanning the text again.
    """
    df = df.withColumn("_clean", T.clean_text(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("words", T.word_count(F.col("_clean"))).withColumn("hits", hits_map(F.col("_clean"), lang))
    df = df.withColumn("tier1", tier1(F.col("hits"), F.col("words"), lang)).drop("_clean")
    d = T.density(F.col("tier1"), F.col("words"))
    return df.withColumn("density", F.round(d, 2)).withColumn("band", T.band(d))


def rule_hits(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, rule, hits`` of every rule that fires."""
    scored = df.select(key, hits_map(T.clean_text(F.col(text)), lang).alias("hits"))
    return scored.select(key, F.explode(F.map_filter("hits", lambda k, v: v > 0)).alias("rule", "hits"))


def paragraph_scores(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, paragraph, words, tier1, density, band``, paragraphs numbered from 1.

    A mostly Hebrew paragraph of an English document counts rules of form only.
    """
    parts = _paragraph_hits(df, key, text, lang).withColumn("tier1", tier1(F.col("hits"), F.col("words"), lang))
    d = T.density(F.col("tier1"), F.col("words"))
    return parts.select(key, "paragraph", "words", "tier1", F.round(d, 2).alias("density"), T.band(d).alias("band"))


def _paragraph_hits(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, paragraph, words, hits`` of each paragraph; its script is looked at once, before the rules are counted."""
    foreign = (lambda p: T.hebrew_share(p) > 0.4) if lang == "en" else lambda p: F.lit(False)
    parts = F.transform(T.paragraphs(T.clean_text(F.col(text))), lambda p: F.struct(p.alias("p"), foreign(p).alias("foreign")))
    parts = df.select(key, F.posexplode(parts).alias("at", "x"))
    hits = hits_map(F.col("x.p"), lang, F.col("x.foreign") if lang == "en" else None)
    return parts.select(key, (F.col("at") + 1).cast("long").alias("paragraph"), T.word_count(F.col("x.p")).alias("words"), hits.alias("hits"))


def paragraph_hits(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, paragraph, rule, hits`` of every rule that fires in a paragraph, as ``paragraph_scores`` counts them."""
    parts = _paragraph_hits(df, key, text, lang)
    return parts.select(key, "paragraph", F.explode(F.map_filter("hits", lambda k, v: v > 0)).alias("rule", "hits"))


def dimension_scores(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, dimension, hits, density`` of the seven dimensions, thresholds ignored."""
    scored = score(df, text, lang)
    members = {d: [r.key for r in pack(lang) if r.dimension == d] for d in DIMENSIONS}
    zero = F.lit(0).cast("long")
    sums = [F.struct(F.lit(d).alias("dimension"), sum((F.col("hits")[k] for k in m), zero).alias("hits")) for d, m in members.items()]
    long = scored.select(key, "words", F.explode(F.array(*sums)).alias("d"))
    return long.select(key, "d.dimension", "d.hits", F.round(T.density(F.col("d.hits"), F.col("words")), 2).alias("density"))


def rhythm(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sentences, mean, stdev, cv, verdict``: spread of sentence lengths; ``n/a`` under three sentences.

    Computed in the row from the array of lengths, so no text is shuffled.
    """
    lengths = F.transform(T.sentences(T.clean_text(F.col(text))), lambda s: T.word_count(s).cast("double"))
    df = df.select(key, lengths.alias("x")).filter("x is not null").withColumn("n", F.size("x").cast("long"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    df = df.withColumn("m", F.when(F.col("n") >= 3, total / F.col("n")))
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m")))
    df = df.withColumn("s", F.when(F.col("n") >= 3, F.sqrt(squares / (F.col("n") - 1)))).withColumn("cv", F.col("s") / F.col("m"))
    verdict = F.when(F.col("n") < 3, "n/a").when(F.col("cv") < 0.35, "METRONOMIC").when(F.col("cv") > 0.6, "VARIED").otherwise("OK")
    zero = lambda c, d: F.coalesce(F.round(c, d), F.lit(0.0))
    return df.select(key, F.col("n").alias("sentences"), zero("m", 1).alias("mean"), zero("s", 1).alias("stdev"), F.round("cv", 2).alias("cv"), verdict.alias("verdict"))


def top_rules(df: DataFrame, key: str, text: str, k: int = 5, lang: str = "en") -> DataFrame:
    """``key, place, rule, hits``: the ``k`` rules with most hits of each text, ties by name; in the row, without a shuffle."""
    hits = F.map_entries(F.map_filter(hits_map(T.clean_text(F.col(text)), lang), lambda r, v: v > 0))
    order = F.array_sort(F.transform(hits, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("rule"))))
    top = df.select(key, F.posexplode(F.slice(order, 1, k)).alias("place", "e"))
    return top.select(key, (F.col("place") + 1).cast("long").alias("place"), F.col("e.rule").alias("rule"), (-F.col("e.n")).alias("hits"))
