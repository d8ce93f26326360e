"""The text functions as DuckDB SQL, to check results on another engine."""

from __future__ import annotations

from lexisift.functions.text import GERMAN_WORDS, HIDDEN_TAGS, MARKDOWN, WIKITEXT, WORD
from lexisift.lexicon import Rule, pack, re2

S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pattern)})) AS BIGINT)"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"\A{S}+|{S}+\z")


def clean(x: str) -> str:
    return sub(sub(x, "(?s)```.*?```"), "(?m)^>.*$")


def words(x: str) -> str:
    return count(x, WORD)


def spaced(x: str) -> str:
    return f"regexp_extract_all({x}, {q(NS + '+')})"


def whole(terms: str) -> str:
    """Pattern of whole terms in any case; RE2's own boundary minds ASCII letters alone, so the sign before is matched too."""
    return r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + terms + r")\b"


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {q(rf'\n{S}*\n')}), lambda p: {strip('p')}), lambda p: p <> '')"


def sentences(x: str) -> str:
    marked = sub(strip(x), rf"([.!?]){S}+([A-Z\x{{590}}-\x{{5FF}}])", "\\1\x1f\\2")
    return f"list_filter(string_split({marked}, {q(chr(31))}), lambda s: {words('s')} > 0)"


def tokens(x: str) -> str:
    edge = r"\A[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+\z"
    return f"list_filter(list_transform({spaced(f'lower({x})')}, lambda t: {sub('t', edge)}), lambda t: length(t) > 1 AND NOT regexp_full_match(t, '\\p{{Nd}}+'))"


def ngrams(toks: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({toks}) - {n - 1}, 0) + 1), lambda i: array_to_string(list_slice({toks}, i, i + {n - 1}), ' '))"


def density(h: str, w: str) -> str:
    return f"(CASE WHEN {w} > 0 THEN CAST({h} AS DOUBLE) / {w} * 100 ELSE 0.0 END)"


def band(d: str) -> str:
    return f"(CASE WHEN {d} < 3 THEN 'LOW' WHEN {d} < 6 THEN 'MEDIUM' ELSE 'HIGH' END)"


def hits(x: str, rule: Rule) -> str:
    if rule.key != "em_dash_overuse":
        return count(x, rule.re2)
    runs = rf"[\p{{L}}\p{{N}}_]?-{{2,}}"
    return f"({count(x, '—| – ')} + CAST(len(list_filter(regexp_extract_all({x}, {q(runs)}), lambda r: r = '--' OR length(r) - length(replace(r, '-', '')) >= 3)) AS BIGINT))"


def all_hits(x: str, lang: str) -> str:
    """Struct of hits by rule."""
    return "{" + ", ".join(f"{q(r.key)}: {hits(x, r)}" for r in pack(lang)) + "}"


def tier1(h: str, w: str, lang: str) -> str:
    parts = [f"{h}.{r.key}" if r.threshold is None else f"(CASE WHEN {density(f'{h}.{r.key}', w)} > {r.threshold} THEN {h}.{r.key} ELSE 0 END)" for r in pack(lang)]
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


def scored(source: str, key: str, text: str, lang: str, extra: str = "") -> str:
    """CTE body with key, words, hits struct h, tier1 and density d; ``source`` is a relation."""
    a = f"SELECT {key}{extra}, {clean(f'coalesce({text}, {q('')})')} AS c FROM {source}"
    b = f"SELECT *, {words('c')} AS words, {all_hits('c', lang)} AS h FROM ({a})"
    return f"SELECT *, {density('tier1', 'words')} AS d FROM (SELECT *, {tier1('h', 'words', lang)} AS tier1 FROM ({b}))"


def long_hits(relation: str, key: str, lang: str) -> str:
    """Rows key, rule, hits from a relation with struct h."""
    items = ", ".join(f"{{'rule': {q(r.key)}, 'hits': h.{r.key}}}" for r in pack(lang))
    return f"SELECT {key}, u.rule AS rule, u.hits AS hits FROM (SELECT {key}, unnest([{items}]) AS u FROM {relation})"


def german(x: str) -> str:
    rx = r"\b(" + "|".join(GERMAN_WORDS) + r")\b"
    return f"len(list_distinct(regexp_extract_all(lower(substring({x}, 1, 500)), {q(rx)}))) >= 4"


def steps(x: str, chain: list[tuple[str, str]]) -> str:
    for pattern, by in chain:
        x = sub(x, re2(pattern), by.replace("$", "\\"))
    return x


def wikitext(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({steps(x, WIKITEXT)}, {q(chr(10))}), lambda l: {strip('l')}), lambda l: l <> ''), {q(chr(10))})"


def markdown(x: str) -> str:
    return strip(steps(x, MARKDOWN))


def html_paragraphs(x: str) -> str:
    x = sub(x, r"(?s)<!--.*?-->", " ")
    for t in HIDDEN_TAGS:
        x = sub(x, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ")
    inner = f"regexp_extract_all({x}, {q(r'(?is)<p\b[^>]*>(.*?)</p\s*>')}, 1)"
    plain = f"list_transform({inner}, lambda p: array_to_string({spaced(unescape(sub('p', '<[^>]+>', ' ')))}, ' '))"
    kept = f"list_filter({plain}, lambda p: len({spaced('p')}) >= 8)"
    return f"array_to_string(list_slice({spaced(f'array_to_string({kept}, {q(' ')})')}, 1, 400), ' ')"


def unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x
