"""Text functions as Column expressions; null texts give null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexisift.lexicon import java

# Fixed value: words that mark German text.
GERMAN_WORDS = "der die das und ist in zu ein eine ich wir mit von auf für den des dem nicht auch an es war sind".split()
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
SPACES = java(r"\s+")
EDGES = java(r"^\s+|\s+$")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, EDGES, "")


def clean_text(c: Column) -> Column:
    """Without fenced code and quoted lines."""
    return F.regexp_replace(F.regexp_replace(c, java("```.*?```", "s"), ""), java("^>.*$", "m"), "")


def word_count(c: Column) -> Column:
    """Words: runs of letters, digits and inner apostrophes."""
    return count(c, WORD)


def spaced_words(c: Column) -> Column:
    """Pieces between blanks."""
    return all_matches(c, java(r"\S+"))


def spaced_word_count(c: Column) -> Column:
    return count(c, java(r"\S+"))


def paragraphs(c: Column) -> Column:
    """Non-empty stripped blocks between blank lines."""
    return F.filter(F.transform(F.split(c, java(r"\n\s*\n")), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Pieces that end with ``. ! ?`` before a capital A-Z or a Hebrew letter, with at least one word."""
    parts = F.split(strip(c), java(r"(?<=[.!?])\s+(?=[A-Z֐-׿])"))
    return F.filter(parts, lambda s: word_count(s) > 0)


def tokens(c: Column) -> Column:
    """Lower-case pieces without signs at their edges; numbers and single characters are left out."""
    bare = F.transform(spaced_words(F.lower(c)), lambda t: F.regexp_replace(t, java(r"^[^\w]+|[^\w]+$"), ""))
    return F.filter(bare, lambda t: (F.length(t) > 1) & ~t.rlike(java(r"^\d+$")))


def ngrams(toks: Column, n: int) -> Column:
    """Neighbouring tokens joined by a blank; none if there are fewer than ``n``."""
    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))


def density(hits: Column, words: Column) -> Column:
    """Hits per 100 words, 0 without words."""
    return F.when(words > 0, hits / words * 100).otherwise(F.lit(0.0))


def band(d: Column) -> Column:
    return F.when(d < 3, "LOW").when(d < 6, "MEDIUM").otherwise("HIGH")


def hebrew_share(c: Column) -> Column:
    """Share of Hebrew signs among letters; 0 without letters."""
    letters = count(c, r"\p{L}")
    return F.when(letters > 0, count(c, "[֐-׿]") / letters).otherwise(F.lit(0.0))


def looks_german(c: Column, least: int = 4) -> Column:
    """Whether the first 500 characters hold enough distinct German function words."""
    found = all_matches(F.lower(F.substring(c, 1, 500)), java(rf"\b({'|'.join(GERMAN_WORDS)})\b"), 1)
    return F.size(F.array_distinct(found)) >= least


def language(c: Column) -> Column:
    """``de`` for German texts, else ``en``, the language without a pack of its own too; a null text is ``en``."""
    return F.when(F.coalesce(looks_german(c), F.lit(False)), "de").otherwise("en")


def strip_frontmatter(c: Column) -> Column:
    """Without a block between ``---`` lines at the very start."""
    return F.regexp_replace(c, java(r"\A---\s*\n.*?\n---\s*\n", "s"), "")


def frontmatter_field(c: Column, name: str) -> Column:
    """Value of a (possibly indented) field of the leading block; empty without it."""
    head = F.regexp_extract(c, java(r"\A---\n(.*?)\n---\n", "s"), 1)
    return strip(F.regexp_extract(head, java(rf"^[ \t]*{name}:[ \t]*(.*)$", "m"), 1))


def sample_domain(c: Column) -> Column:
    """Domain named in a sample's leading block, else ``casual``."""
    d = frontmatter_field(c, "domain")
    return F.when(d == "", "casual").otherwise(d)


def sample_body(c: Column) -> Column:
    return strip(F.regexp_replace(c, java(r"\A---\n.*?\n---\n", "s"), ""))


def trim_words(c: Column, most: int, least: int) -> Column:
    """The first ``most`` pieces joined by one blank, or empty if there are fewer than ``least``."""
    w = spaced_words(c)
    return F.when(F.size(w) < least, "").otherwise(F.array_join(F.slice(w, 1, most), " "))


def slug(prefix: Column, title: Column, size: int = 80) -> Column:
    """File-safe id: lower case, other signs as single underscores, prefix, cut to ``size``."""
    s = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\-]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    return F.substring(F.concat(prefix, F.lit("_"), s), 1, size)


def yaml_scalar(c: Column) -> Column:
    """Value as YAML scalar: quoted if it holds signs with a meaning or a line break."""
    special = c.rlike(r"[:\-{}\[\],&*#?|<>=!%@`\n]") | c.rlike(r"""^['"]""")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(special, quoted).otherwise(c)


def frontmatter(fields: dict[str, Column], metadata: Column) -> Column:
    """Leading block of ``fields`` in order and of a map column, indented below ``metadata``."""
    rows = [F.concat(F.lit(f"{k}: "), yaml_scalar(F.coalesce(v, F.lit("None")))) for k, v in fields.items()]
    inner = F.transform(F.map_entries(metadata), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), yaml_scalar(F.coalesce(e["value"], F.lit("None")))))
    meta = F.when(F.size(inner) > 0, F.concat(F.lit("metadata:\n"), F.array_join(inner, "\n")))
    return F.concat_ws("\n", F.lit("---"), *rows, meta, F.lit("---"))


def _steps(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, java(s[0]), s[1]), steps, c)


# Markup that goes, and what stays of it, in this order.
WIKITEXT = [
    (r"(?is)<ref[^>]*?>.*?</ref>", " "), (r"(?i)<ref[^/]*/?>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+?>", " "),
    *[(r"\{\{[^{}]*?\}\}", " ")] * 5,
    (r"(?i)\[\[(?:File|Datei|Image|Bild):[^\]]*?\]\]", " "), (r"\[\[([^\]|]*?)\|([^\]]*?)\]\]", "$1 $2"), (r"\[\[([^\]]*?)\]\]", "$1"),
    (r"\[https?://\S+\s+([^\]]+?)\]", "$1"), (r"\[https?://\S+\]", " "), (r"={2,6}[^=]+?={2,6}", " "),
    (r"(?m)^\s*(\||!|\{\||\|\})", " "), (r"'{2,3}", ""), (r"#\w+:[^\n]*", " "), (r"\n{3,}", "\n\n"),
]
# The same for Markdown.
MARKDOWN = [
    (r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"#{1,6}\s+", " "), (r"<[^>]+?>", " "), (r"\s+", " "),
]


def strip_wikitext(c: Column) -> Column:
    """Prose of wiki markup; lines are stripped and empty ones left out."""
    lines = F.filter(F.transform(F.split(_steps(c, WIKITEXT), "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n")


def markdown_plain(c: Column) -> Column:
    """Plain text of Markdown on one line."""
    return strip(_steps(c, MARKDOWN))


HIDDEN_TAGS = "script style nav header footer aside noscript".split()
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)


def html_paragraphs(c: Column, least: int = 8, most: int = 400) -> Column:
    """Text of visible ``<p>`` elements of at least ``least`` words, together at most ``most`` words."""
    shown = reduce(lambda x, t: F.regexp_replace(x, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " "), HIDDEN_TAGS, F.regexp_replace(c, r"(?s)<!--.*?-->", " "))
    inner = all_matches(shown, r"(?is)<p\b[^>]*>(.*?)</p\s*>", 1)
    plain = F.transform(inner, lambda p: F.array_join(spaced_words(unescape(F.regexp_replace(p, "<[^>]+>", " "))), " "))
    kept = F.filter(plain, lambda p: spaced_word_count(p) >= least)
    return F.array_join(F.slice(spaced_words(F.array_join(kept, " ")), 1, most), " ")


def html_text(c: Column) -> Column:
    """Text without tags, entities resolved."""
    return unescape(F.regexp_replace(c, "<[^>]+>", ""))


def url_quote(title: Column) -> Column:
    """Title as part of a path: blanks as underscores, other signs in percent form."""
    return F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("%2F"), F.lit("/"))


def decode_base64(c: Column) -> Column:
    return F.decode(F.unbase64(F.regexp_replace(c, r"\s", "")), "UTF-8")


def numbers(c: Column) -> Column:
    """Distinct numbers of a text."""
    return F.array_distinct(all_matches(c, r"[0-9]+(?:[.,][0-9]+)*"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval; (0, 1) without trials."""
    p = k / n
    denominator = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denominator
    margin = F.lit(z) / denominator * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), centre + margin)).otherwise(1.0)
