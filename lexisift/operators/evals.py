"""Reports over cases, rewrites, scores and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.lexicon import BRIDGE, QUICK_RULES, SHARED_RULES, TIER1_RULES, any_of, java, levels, modes, pack, rules
from lexisift.operators import rewrite, scan


def flat_cases(files: DataFrame) -> DataFrame:
    """One row for each case of pattern files, with the file's header and defaults for missing fields.

    Repeated files give repeated rows; files with empty or null ``cases`` give none.
    """
    c = F.col("c")
    none = F.array().cast("array<string>")
    return files.select("pattern_id", "pattern_name", "lang", F.explode("cases").alias("c")).select(
        "pattern_id", "pattern_name", "lang", c["id"].alias("id"), c["input"].alias("input"), F.coalesce(c["expected_changes"], none).alias("expected_changes"),
        F.coalesce(c["expected_unchanged"], none).alias("expected_unchanged"), F.coalesce(c["domain"], F.lit("")).alias("domain"),
        F.coalesce(c["source"], F.lit("")).alias("source"), F.coalesce(c["notes"], F.lit("")).alias("notes"), F.coalesce(c["true_negative"], F.lit(False)).alias("true_negative"),
    )


def present(terms: Column, text: Column) -> Column:
    """Terms that occur in a text, whatever their case; none of a null text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(terms, lambda t: F.contains(low, F.lower(t)))


def selected(cases: DataFrame, **wanted: list | None) -> DataFrame:
    """Rows of ``cases`` whose columns are among the ``wanted`` values (by column name); a column without values takes all."""
    return reduce(lambda df, kv: df.filter(F.col(kv[0]).isin(kv[1])) if kv[1] else df, wanted.items(), cases)


def previewed(cases: DataFrame, text: str, size: int = 200) -> DataFrame:
    """``cases`` with ``preview`` (the first ``size`` signs of ``text``, lower case) and ``pieces``, its number of pieces between blanks; empty and 0 for a null text."""
    c = F.coalesce(F.col(text), F.lit(""))
    return cases.withColumn("preview", F.substring(F.lower(c), 1, size)).withColumn("pieces", T.spaced_word_count(c))


def case_status(input: str = "input") -> Column:
    """true_negative, unscorable_empty, unscorable_no_trigger or scorable."""
    found = F.size(present(F.col("expected_changes"), F.col(input)))
    return F.when(F.col("true_negative"), "true_negative").when(F.size("expected_changes") == 0, "unscorable_empty").when(found == 0, "unscorable_no_trigger").otherwise("scorable")


def term_removal(cases: DataFrame, output: str) -> DataFrame:
    """``cases`` with ``status, terms_present, terms_removed, detected``: which expected terms the rewrite took out."""
    df = cases.withColumn("status", case_status()).withColumn("_there", present(F.col("expected_changes"), F.col("input")))
    kept = F.size(present(F.col("_there"), F.col(output)))
    df = df.withColumn("terms_present", F.size("_there").cast("long")).withColumn("terms_removed", (F.size("_there") - kept).cast("long"))
    return df.withColumn("detected", (F.col("status") == "scorable") & (kept == 0)).drop("_there")


def pattern_report(cases: DataFrame, threshold: float = 0.85) -> DataFrame:
    """A row for each pattern: cases, scorable ones, detected ones, rate, rate of removed terms, whether below ``threshold``.

    Cases that can't be scored are counted, but not as misses; a rate without cases is null.
    """
    ok = F.col("status") == "scorable"
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = cases.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("cases"), one(ok).alias("scorable"), one(ok & F.col("detected")).alias("detected"), one(F.col("status") == "true_negative").alias("true_negatives"),
        one(F.col("status").startswith("unscorable")).alias("unscorable"), F.sum(F.when(ok, F.col("terms_present")).otherwise(0)).alias("_p"), F.sum(F.when(ok, F.col("terms_removed")).otherwise(0)).alias("_r"),
    )
    rate = F.when(F.col("scorable") > 0, F.col("detected") / F.col("scorable"))
    out = out.withColumn("rate", F.round(rate, 4)).withColumn("term_rate", F.when(F.col("_p") > 0, F.round(F.col("_r") / F.col("_p"), 4)))
    return out.withColumn("below", F.coalesce(rate < threshold, F.lit(False))).drop("_p", "_r")


def overedit_report(cases: DataFrame, group: str, ratio: str = "median", threshold: float = 0.10) -> DataFrame:
    """A row for each group: cases, mean of the median ratios, cases above ``threshold``, flaky and inconclusive ones."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return cases.groupBy(group).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(ratio), 4).alias("mean_ratio"), one(F.col(ratio) > threshold).alias("above"),
        one(F.col("flaky")).alias("flaky"), one(F.col("inconclusive")).alias("inconclusive"),
    )


def judge_report(case_scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row: mean of the cases' means, and cases under the threshold by mean or by median, for each score."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    aggs = [F.count(F.lit(1)).alias("cases")]
    for k, t in thresholds.items():
        aggs += [F.round(F.avg(f"{k}_mean"), 3).alias(k), one(F.col(f"{k}_mean") < t).alias(f"{k}_below"), one(F.col(f"{k}_median") < t).alias(f"{k}_median_below")]
    worst = reduce(lambda a, b: a | b, (F.col(f"{k}_mean") < t for k, t in thresholds.items()))
    return case_scores.agg(*aggs, one(worst).alias("any_below"))


def bridge(spark: SparkSession) -> DataFrame:
    """``rule_id, keys``: the counted patterns of each rule; a fixed table of 40 rows."""
    return spark.createDataFrame([(i, k.split()) for i, k in BRIDGE.items()], "rule_id int, keys array<string>")


def audit(cases: DataFrame, lang: str = "en") -> DataFrame:
    """``cases`` with ``signal``: unmapped (no pattern for the rule), fires or no_signal.

    The rule's patterns come by a broadcast join with a fixed table.
    """
    hits = scan.hits_map(T.clean_text(F.coalesce(F.col("input"), F.lit(""))), lang)
    joined = cases.withColumn("_hits", hits).join(F.broadcast(bridge(cases.sparkSession)), F.col("pattern_id") == F.col("rule_id"), "left")
    fires = F.exists("keys", lambda k: F.coalesce(F.try_element_at("_hits", k), F.lit(0)) > 0)
    unmapped = F.col("keys").isNull() | (F.size("keys") == 0)
    return joined.withColumn("signal", F.when(unmapped, "unmapped").when(fires, "fires").otherwise("no_signal")).drop("_hits", "keys", "rule_id")


def rule_table(spark: SparkSession, lang: str = "en") -> DataFrame:
    """``rule_id, name, pack, tier1, patterns, modes`` of a language's rules; a fixed table of under 50 rows."""
    by_mode = modes(lang)
    rows = [(i, name, "universal" if i in SHARED_RULES else lang, i in TIER1_RULES, BRIDGE.get(i, "").split(), [m for m, ids in by_mode.items() if i in ids]) for i, name in sorted(rules(lang).items())]
    return spark.createDataFrame(rows, "rule_id int, name string, pack string, tier1 boolean, patterns array<string>, modes array<string>")


def mode_hits(hits: DataFrame, mode: str, lang: str = "en") -> DataFrame:
    """Rows of ``hits`` (with ``rule_id``) whose rule belongs to ``mode``; an unknown mode is an error."""
    return hits.filter(F.col("rule_id").isin(modes(lang)[mode]))


def unknown_levels(spark: SparkSession, lang: str) -> DataFrame:
    """``rule_id`` of the override table that no pack of the language has; must be empty."""
    return override_levels(spark, lang).select("rule_id").subtract(rule_table(spark, lang).select("rule_id"))


def override_levels(spark: SparkSession, lang: str) -> DataFrame:
    """``rule_id, domain, level``; English has the German rows without the rules of that pack alone."""
    rows = [r for r in levels() if lang == "de" or r[0] < 100 and r[0] != 11]
    return spark.createDataFrame(rows, "rule_id int, domain string, level string")


def apply_levels(hits: DataFrame, lang: str, light: int = 3) -> DataFrame:
    """Rows of ``hits`` (``rule_id, domain, hits``) with ``level`` and ``applies``.

    What no table row names is strict; a skipped rule never applies, a light one from ``light`` hits.
    """
    table = F.broadcast(override_levels(hits.sparkSession, lang))
    out = hits.join(table, ["rule_id", "domain"], "left").withColumn("level", F.coalesce("level", F.lit("strict")))
    return out.withColumn("applies", F.when(F.col("level") == "SKIP", False).when(F.col("level") == "light", F.col("hits") >= light).otherwise(F.col("hits") > 0))


def rules_of(keys_of: tuple[int, ...]) -> list[str]:
    """Counted patterns of several rules, each once."""
    return sorted({k for i in keys_of for k in BRIDGE[i].split()})


def route(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, tells, route``: quick, mixed or full by the first-tier rules' hits per 100 words."""
    scored = scan.score(df, text, lang)
    own = {r.key for r in pack(lang)}
    tells = sum((F.col("hits")[k] for k in rules_of(TIER1_RULES) if k in own), F.lit(0).cast("long"))
    d = T.density(tells, F.col("words"))
    return scored.select(key, tells.alias("tells"), F.when(d < 1, "quick").when(d < 3, "mixed").otherwise("full").alias("route"))


def quick_hits(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, hits`` over the rules of the quick mode alone."""
    own = {r.key for r in pack(lang)}
    hits = scan.hits_map(T.clean_text(F.coalesce(F.col(text), F.lit(""))), lang)
    return df.select(key, hits.alias("h")).select(key, sum((F.col("h")[k] for k in rules_of(QUICK_RULES) if k in own), F.lit(0).cast("long")).alias("hits"))


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``plan`` whose keys are not in ``done``."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def reused(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``plan`` whose keys are in ``done``."""
    return plan.join(done.select(*keys).distinct(), keys, "left_semi")


def plan_grid(spark: SparkSession, **axes: list[str]) -> DataFrame:
    """All combinations of a few small lists, made without a join."""
    df = spark.range(1)
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df.drop("id")


def pooled_rate(df: DataFrame, groups: list[str], good: Column) -> DataFrame:
    """Counts and rate for each level of ``groups`` and over all (null group)."""
    out = df.rollup(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(good, 1).otherwise(0)).cast("long").alias("k"))
    return out.withColumn("rate", F.round(F.col("k") / F.col("n"), 4))


def rate_with_interval(df: DataFrame, group: str, good: Column) -> DataFrame:
    """``group, k, n, rate, low, high`` with the Wilson interval."""
    out = df.groupBy(group).agg(F.sum(F.when(good, 1).otherwise(0)).cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = T.wilson(F.col("k"), F.col("n"))
    return out.select(group, "k", "n", F.round(F.col("k") / F.col("n"), 4).alias("rate"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def hash_compare(a: DataFrame, b: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, status`` of files on two sides: same, differs, only_a or only_b, by SHA-256."""
    x = a.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("_a"))
    y = b.select(path, F.sha2(F.col(content).cast("binary"), 256).alias("_b"))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("_a") == F.col("_b"), "same").otherwise("differs")
    return x.join(y, path, "full").select(path, status.alias("status"))


# Derived from prose rules, not from code: they label such output in the README.
# Word clusters by era, and words that point to a domain.
ERAS = {
    "2023-2024": "additionally; boasts; bolstered; crucial; delve; emphasizing; enduring; garner; intricate; intricacies; interplay; key; landscape; meticulous; meticulously; pivotal; underscore; tapestry; testament; valuable; vibrant",
    "2024-2025": "align with; bolstered; crucial; emphasizing; enhance; enduring; fostering; highlighting; pivotal; showcasing; underscore; vibrant",
    "2025-": "emphasizing; enhance; highlighting; showcasing",
}
DOMAIN_WORDS = {
    "academic": "we propose|this paper|hypothesis|et al|methodology",
    "legal": "plaintiff|defendant|whereas|shall|pursuant",
    "technical": "api|command line|parameter|install|server",
    "marketing": "sign up|buy now|value proposition|customers|brand",
    "career": "application|cover letter|hiring|resume|sincerely",
}
SUBJUNCTIVE = r"\b(würden?|wäre[n]?|hätten?|könnten?|sollten?|müssten?|dürften?)\b"


def era_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, era, hits`` of the eras whose words occur."""
    n = F.create_map(*(x for e, w in ERAS.items() for x in (F.lit(e), T.count(F.col(text), java(rf"\b({any_of(w)})\b", "i")))))
    return df.select(key, F.explode(F.map_filter(n, lambda k, v: v > 0)).alias("era", "hits"))


def dated(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, era, hits``: the era whose words occur most, the earlier one of equals; only texts with such words. Keys are taken as unique."""
    n = F.array(*(F.struct((-T.count(F.col(text), java(rf"\b({any_of(w)})\b", "i"))).alias("n"), F.lit(e).alias("era")) for e, w in ERAS.items()))
    best = df.select(key, F.element_at(F.array_sort(n), 1).alias("e")).filter("e.n < 0")
    return best.select(key, "e.era", (-F.col("e.n")).alias("hits"))


def subjunctive_paragraphs(df: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """``key, paragraph, forms`` of the paragraphs with at least ``least`` subjunctive forms close together, paragraphs numbered from 1."""
    rows = df.select(key, F.posexplode(T.paragraphs(F.col(text))).alias("paragraph", "p"))
    rows = rows.select(key, (F.col("paragraph") + 1).cast("long").alias("paragraph"), T.count(F.col("p"), java(SUBJUNCTIVE, "i")).alias("forms"))
    return rows.filter(F.col("forms") >= least)


def infer_domain(c: Column) -> Column:
    """Domain with most indicator words, ties alphabetically; casual without any."""
    ranked = F.array_sort(F.array(*(F.struct((-T.count(c, java(rf"\b({w})\b", "i"))).alias("n"), F.lit(d).alias("d")) for d, w in DOMAIN_WORDS.items())))
    top = F.element_at(ranked, 1)
    return F.when(F.coalesce(top["n"], F.lit(0)) < 0, top["d"]).otherwise("casual")


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, sentence, words, opener`` of each sentence, numbered from 1."""
    rows = df.select(key, F.posexplode(T.sentences(F.col(text))).alias("n", "sentence"))
    return rows.select(key, (F.col("n") + 1).cast("long").alias("n"), "sentence", T.word_count(F.col("sentence")).alias("words"), F.lower(F.regexp_extract("sentence", T.WORD, 0)).alias("opener"))


def opener_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, runs``: sentences that open like the two before them; only texts with some."""
    w = Window.partitionBy(key).orderBy("n")
    rows = sentence_rows(df, key, text)
    same = (F.col("opener") == F.lag("opener", 1).over(w)) & (F.col("opener") == F.lag("opener", 2).over(w))
    return rows.withColumn("same", same).filter("same").groupBy(key).agg(F.count(F.lit(1)).alias("runs"))


def staccato_runs(df: DataFrame, key: str, text: str, short: int = 8, least: int = 3) -> DataFrame:
    """``key, first, length`` of runs of at least ``least`` sentences with at most ``short`` words."""
    w = Window.partitionBy(key).orderBy("n")
    rows = sentence_rows(df, key, text).withColumn("brief", F.col("words") <= short)
    rows = rows.withColumn("island", F.sum(F.when(F.col("brief"), 0).otherwise(1)).over(w)).filter("brief")
    return rows.groupBy(key, "island").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("island")
