"""Comparison of a text with its rewrite, and reading of raw responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.lexicon import java
from lexisift.operators import scan

# Phrases by which a response asks for input in place of a rewrite.
STUBS = (
    "no text provided", "no text to humanize", "what should i humanize", "what text do you want", "paste the text to humanize", "paste the text you want",
    "provide the text to humanize", "provide the text you want", "what do you want me to humanize", "text to humanize?",
)
# What gives a change log away.
CHANGE_HEADER = r"\*\*\s*(?:changes(?: made)?|what changed|summary|audit|notes?|editorial|rationale|diff|removed|edits)\b|concept-noun check|fabrication check|editorial annotation|change[- ]?log"
RULE_LINE = r"^\s*(?:#\s?\d+|pattern\s*#?\d+|§\s?\d+|regel\s*\d+)\b"
CHANGE_LINE = r"^\s*(?:transformationen?|änderungen|changes?|removed|applied|entfernt)\s*:"
CHANGE_BOLD = r"\*\*[^*\n]{0,60}(?:änderung|zusammenfassung der|wesentliche änderung|changes?\b|what changed|edits?\b|überarbeitung|bearbeitung)[^*\n]{0,60}\*\*"
COMMENTARY = r"\n[ \t>]*(?:\*\*\s*(?:changes(?: made)?|what changed|summary|notes?|audit|rationale|why this works|comparison|diff|removed|edits|final ai audit|draft)\b|concept-noun check|fabrication check|new authorial position)"
BANNER = r"^(?:Pre-flight:|Treating this as|\*\*Pre-flight|\*\*Audit|\*\*Final AI audit|\*\*Changes made:|\*\*Domain:)"
# Parts of a response under its headings.
DRAFT = r"\*\*Draft rewrite:\*\*\s*\n(.*?)(?=\n\*\*(?:Final AI audit|Final rewrite|Changes made):|\z)"
FINAL = r"\*\*Final rewrite:\*\*\s*\n(.*?)(?=\n\*\*(?:Changes made|What changed|Summary|Notes|Audit|Rationale|Why this works|Comparison|Diff|Removed|Edits)[: ]|\n---\s*\n|\z)"
OTHER_HEADING = r"\*\*(?:Final|Cleaned text|Rewrite|Quick-mode rewrite):\*\*\s*\n(.*?)(?=\n\*\*|\z)"
QUOTES = r"(?:^>\s?.*(?:\n|\z))+"
LEAK_TOKENS = ("em dash", "em-dash", "remaining", "**change", "pre-flight", "tier-1", "→", " -> ", "audit", "removed #", "wesentliche")


def length_change(before: Column, after: Column) -> Column:
    """Percent by which ``after`` words exceed ``before`` words; 0 without words before."""
    return F.when(before > 0, (after - before) / before * 100).otherwise(F.lit(0.0))


def length_verdict(pct: Column) -> Column:
    return F.when(F.abs(pct) <= 10, "OK").when(pct < -25, "TRUNCATED").when(pct < -10, "SHORTENED").otherwise("EXPANDED")


def compare(df: DataFrame, before: str, after: str, lang: str = "en") -> DataFrame:
    """``df`` with both sides' words, tier 1 and density, the length verdict and maps of rules cleaned and introduced.

    Each side is scanned once.
    """
    for side, c in (("before", before), ("after", after)):
        df = scan.score(df, c, lang).withColumnsRenamed({x: f"{side}_{x}" for x in ("words", "hits", "tier1", "density", "band")})
    pct = length_change(F.col("before_words"), F.col("after_words"))
    df = df.withColumn("length_pct", F.round(pct, 1)).withColumn("length_verdict", length_verdict(pct))
    less = F.map_zip_with("before_hits", "after_hits", lambda k, a, b: a - b)
    more = F.map_zip_with("before_hits", "after_hits", lambda k, a, b: b - a)
    positive = lambda m: F.map_filter(m, lambda k, v: v > 0)
    df = df.withColumn("tier1_removed", F.col("before_tier1") - F.col("after_tier1"))
    return df.withColumn("cleaned", positive(less)).withColumn("introduced", positive(more)).drop("before_hits", "after_hits")


def is_refusal(c: Column) -> Column:
    """Blank, or asking for the text."""
    low = F.lower(c)
    return c.isNull() | (T.strip(c) == "") | reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in STUBS))


def is_change_log(c: Column) -> Column:
    """Whether a rewrite is blank or holds the signs of a change log."""
    return (
        (T.strip(c) == "") | c.rlike(java(CHANGE_HEADER, "i")) | (T.count(c, "→|->") >= 2) | (T.count(c, java(RULE_LINE, "im")) >= 2)
        | c.rlike(java(CHANGE_LINE, "im")) | c.rlike(java(CHANGE_BOLD, "i"))
    )


def leaks(before: Column, after: Column) -> Column:
    """Whether a rewrite of a sound text is too long or talks about the rewriting."""
    low = F.lower(after)
    return (F.length(after) > F.length(before) * 1.15) | reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in LEAK_TOKENS)) | is_change_log(after)


def edit_ratio(before: Column, after: Column) -> Column:
    """Edit distance by the length of ``before``; may exceed 1."""
    return F.levenshtein(before, after) / F.greatest(F.length(before), F.lit(1))


def guarded_edit_ratio(before: Column, after: Column) -> Column:
    """Edit ratio; 0 where the rewrite repeats the text and only appends a remark."""
    a, b = T.strip(before), T.strip(after)
    verbatim = F.startswith(b, a) & (F.length(b) > F.length(a))
    return F.when(verbatim, F.lit(0.0)).otherwise(edit_ratio(before, after))


def quick_drop(preflight: Column) -> Column:
    low = F.lower(F.coalesce(preflight, F.lit("")))
    return F.contains(low, F.lit("quick")) & (F.contains(low, F.lit("0 tier-1")) | F.contains(low, F.lit("0/100")) | F.contains(low, F.lit("human-authored")))


def unquote(c: Column) -> Column:
    """Without quotation marks at the starts of lines."""
    return T.strip(F.regexp_replace(T.strip(c), java("^> ?", "m"), ""))


def cut_commentary(c: Column, fence: str) -> Column:
    """Without what follows the fence or a heading of commentary, whichever comes first."""
    right = java(r"\s+\z")
    at = F.instr(c, fence)
    c = F.when(at > 0, F.regexp_replace(F.substring_index(c, fence, 1), right, "")).otherwise(c)
    start = java(COMMENTARY, "i")
    cut = F.regexp_replace(F.regexp_replace(c, java(f"(?:{COMMENTARY}).*", "is"), ""), right, "")
    return F.when(c.rlike(start), cut).otherwise(c)


def parse_response(df: DataFrame, raw: str, fence: str) -> DataFrame:
    """``df`` with ``domain, preflight, draft, final`` of a raw response; parts that are missing are empty.

    Without the headings of a rewrite, the first that exists counts: a block under another heading,
    the last quotation, the text behind the last rule if it is no banner, the whole text if no
    line is a banner. A null response gives empty parts. ``fence`` is the mark that the responses fence commentary off with.
    """
    r = F.coalesce(F.col(raw), F.lit(""))
    take = lambda p, flags="", g=1: F.regexp_extract(r, java(p, flags), g)
    tidy = lambda c: cut_commentary(unquote(c), fence)
    draft, final = take(DRAFT, "s"), take(FINAL, "s")
    quotes = T.all_matches(r, java(QUOTES, "m"))
    banner = java(BANNER, "m")
    last = T.strip(F.substring_index(r, "---", -1))
    fallback = (
        F.when(r.rlike(java(OTHER_HEADING, "s")), tidy(take(OTHER_HEADING, "s")))
        .when(F.size(quotes) > 0, tidy(F.element_at(quotes, -1)))
        .when(F.contains(r, F.lit("---")) & (last != "") & ~last.rlike(banner), cut_commentary(last, fence))
        .when(~r.rlike(banner), cut_commentary(T.strip(r), fence))
        .otherwise("")
    )
    df = df.withColumn("domain", F.lower(take(r"Treating this as \*\*(\w+)\*\* writing", "i"))).withColumn("preflight", take(r"(Pre-flight:[^\n]+)", "i"))
    df = df.withColumn("draft", tidy(draft)).withColumn("_final", tidy(final))
    return df.withColumn("final", F.when((F.col("_final") != "") | (F.col("draft") != ""), F.col("_final")).otherwise(fallback)).drop("_final")


def is_fenced(raw: Column, fence: str) -> Column:
    return F.contains(raw, F.lit(fence))


def has_commentary(raw: Column, final: Column) -> Column:
    """Whether more than one sign follows the last place of the rewrite (or of its last 60 signs) in the response."""
    body = T.strip(final)
    tail = F.right(body, F.lit(60))
    rest = F.when(body == "", raw).when(F.contains(raw, body), F.element_at(F.split(raw, F.concat(F.lit("\\Q"), F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), -1))
    rest = rest.when(F.contains(raw, tail), F.element_at(F.split(raw, F.concat(F.lit("\\Q"), F.replace(tail, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), -1)).otherwise("")
    return F.length(T.strip(rest)) > 1
