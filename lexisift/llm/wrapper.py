"""Main body of web pages, by wrappers inferred from pages of the same site."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm import align
from lexisift.llm.lookalike import PLAIN, mapping
from lexisift.session import checkpointed, width

#: Pages, and lines, of a site that one task aligns; a larger site is aligned in several groups whose wrappers are aligned in turn.
BUCKET, BUCKET_LINES = 64, 20_000
#: Share of a site's pages that hold a constant of its wrapper, and the least share of a token that its place can make one.
SUPPORT, LEAST = 0.12, 0.005
#: Share of the sites whose wrapper holds an item that counts as furniture on any site; a single
#: word needs more, as it may name the site's subject.
POOL, POOL_WORD = 0.01, 0.06
#: Share of all rows from which a site's wrapper is sent to all tasks: at most 1 / HOT sites.
HOT = 0.01

# Words of page furniture in German, by what they announce.
NAV = """Startseite|Start|Kontakt|Impressum|Datenschutz|Datenschutzerklärung|AGB|Sitemap|RSS|Jobs|Karriere|Hilfe|Suche|Anmelden|Abmelden|Registrieren|Login|
Mein Konto|Shop|Warenkorb|Newsletter|Podcast|Archiv|Blog|Forum|Magazin|Mediathek|Themen|Ratgeber|Kultur|Wissen|Wetter|Presse|Termine|Spenden|Mitmachen|Abo|
Über uns|Regionales|Mediadaten|Barrierefreiheit|Leichte Sprache|Widerruf|Nutzungsbedingungen|Cookie-Einstellungen|Menü|Navigation|Home"""
BAR = """Teilen|Merken|Drucken|Empfehlen|Weiterleiten|Kommentieren|Bewerten|Vorlesen|Als PDF|Per Mail senden|Link kopieren|Auf die Leseliste|Fehler melden|
Schrift größer|Schrift kleiner|Zum Seitenanfang|Nach oben|Zurück zur Übersicht|Artikel weiterlesen|Anzeige|Werbung|Ablehnen|Alle akzeptieren|Auswahl speichern|
Mehr erfahren|Nur Notwendiges|Zustimmen und weiter|Einstellungen verwalten|Ansichten|Lesen|Bearbeiten|Versionsgeschichte|Vorheriger Beitrag|Nächster Beitrag"""
TEASER = """Meistgelesen|Dossiers|Passend dazu|Aus dem Archiv|Lesen Sie auch|Das könnte Sie auch interessieren|Mehr zum Thema|Auch spannend|Im Gespräch|
Zuletzt kommentiert|Was andere gerade lesen|Beliebte Themen|Beliebte Meldungen|Beliebt in dieser Rubrik|Ähnliche Artikel|Weitere Artikel|Empfohlene Beiträge"""
# Phrases by which a page speaks of itself, its provider or its devices to the reader.
NOTICE = r"""(?i)©|\balle rechte vorbehalten|\bpowered by\b|\bein (angebot|projekt|service) (der|von|des)\b|\bnachdruck nur|\bnicht verantwortlich für (die )?inhalte|
|\bjavascript ist|\bihr browser|\bhilft uns\b.*\bnutzen wir\b|\bstimmen sie zu\b|\bsie sind nicht angemeldet|\beinloggen|\beingeloggt|\bpasswort vergessen|\bbitte melden sie sich an|\bseite nicht gefunden|
|\bzugriff verweigert|\bderzeit nicht verfügbar|\bdiese (web)?seite (hat|wurde|nutzt|verwendet|setzt)\b|\blesezeit\b|^(seite|ergebnis) \d+ von \d+$|^version \d|^fehler \d+$|\bschlagw[oö]rter\s*:|^tags?\s*:|
|^\(c\)|\balle angaben ohne gewähr|\bgegründet \d{4}|\bGmbH\b|\be\. ?V\.|\bamtsgericht\b.*\d|\bfreien? lizenz|\bmarken gehören|\bbetreut von\b|^(bild|foto|grafik|text|autor|autorin|quelle)\s*:\s*\w+/|^veröffentlicht (unter|am|von|in)\b|\bkeine kommentare\b|^gestaltung und technik\b|
|\bwar dieser|\bhat ihnen dies|^\d+ (mal )?(kommentare?|geteilt|aufrufe|likes|bewertungen)$|inhaltsverzeichnis anzeigen|hier endet der artikel|
|\bdruckansicht|\bvorheriger (beitrag|artikel)|\bnächster (beitrag|artikel)|^(menü|navigation)\s*:|☰"""
APPEAL = r"""(?i)\b(newsletter|rundbrief|postfach|mailadresse|spenden?|abo|abonnieren|abonnement|mitglied|probemonat|kündbar|unterstützen|unterstützt uns|werbung|app|anzeige|redaktion|
|partner|dritte|cookies?|tracking\w*|messpixel|gerätekennung\w*|kennungen|textdateien|lokale speicher|einverständnis|privatsphäre|datenschutz\w*|einwilligung|dienste)\b"""
READER = r"\b(Sie|Ihr|Ihre|Ihren|Ihrem|Ihrer|Ihnen|wir|Wir|uns|Uns|unser|Unser|unsere|Unsere|unseren|jetzt|kostenlos|Jeden|Noch mehr|Dürfen)\b|Hinweis zum"
SEPARATORS = r"\s*[|·•/–—›»>→←☰]\s*|\s{2,}"
# Fixed value: names of sections that a site calls after itself.
OWN_ITEM = re.compile(r"(Rund um|Unser|Unsere|Forum|Treffpunkt|Alles über) \S+$")
# Words that no title ends with.
OPEN_END = set("der die das den dem des ein eine einen einem einer von und oder mit für in im auf zu zum zur an am bei als bis ist sind war waren wird hat dass nach vor um aus".split())
_flat = lambda p: re.sub(r"\|?\n\|?", "|", p)


@lru_cache(1)
def _tools() -> tuple:
    table = {ord(c): "".join(p for p, _ in parts) for c, parts in mapping()}
    return table, re.compile(_flat(NOTICE)), re.compile(_flat(APPEAL)), re.compile(READER), re.compile(SEPARATORS), re.compile(f"[^{PLAIN}]")


def plain(line: str) -> str:
    """``line`` with look-alike characters in one form and outer blanks removed."""
    import unicodedata

    return (unicodedata.normalize("NFC", line.translate(_tools()[0])) if not line.isascii() and _tools()[5].search(line) else line).strip()


_MARKS, _DIGITS, _WORD, _HEAD = re.compile(r"^[\W_]+"), re.compile(r"\d+"), re.compile(r"\w+"), re.compile(r"\s*(#{1,6}|={2,6})\s")
_ENDED = re.compile(r"[.!?…“\"]\s*$|[.!?]\s+[A-ZÄÖÜ„\"]")
_NO_TITLE = re.compile(r"[|\t;(),]|\s{3,}|[.!?]\s")
_NUMBERED = re.compile(r"\d+[.)]\s")
_TRAIL = re.compile(r"\s+[›»>/]\s+")


def _token(raw: str) -> str:
    tok = raw if raw[:1].isalpha() else _MARKS.sub("", raw) or raw
    return _DIGITS.sub("#", tok).rstrip(" :")


def token(line: str) -> str:
    """Token of a line: its text without the marks before it, digits as one sign."""
    return _token(plain(line))


@lru_cache(100_000)
def digest(tok: str) -> int:
    """Number of a token, positive, with three bits left free; the fourth is set for several words."""
    return xxhash.xxh3_64_intdigest(tok) >> 1 & ~15 | 8 * (" " in tok)


def pieces(tok: str) -> list[str]:
    """Items of a line that are parted by separators."""
    return [p for p in (x.strip() for x in _tools()[4].split(tok)) if p]


HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@\s]*@)?([^/:?#\s]+)"


def _host(url: F.Column) -> F.Column:
    """``site`` as a column."""
    name = F.regexp_replace(F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(".")), r"^www\.", "")
    return F.when(name != "", name)


def site(url: str | None) -> str | None:
    """Host of a URL however it is written: no scheme, ``www.``, port, case or path."""
    if not url or not (m := re.match(HOST, url)):
        return None
    host = m[1].lower().rstrip(".")
    return host.removeprefix("www.") or None


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def _sentence(line: str) -> bool:
    """Whether a line reads as running prose: several words and an end of sentence or a comma."""
    words = _words(line)
    if len(words) >= 4 and _ENDED.search(line):
        return True
    return len(words) >= 14 and 10 * sum(w[0].islower() for w in words) >= 3 * len(words)


def _headline(raw: str, tok: str) -> bool:
    """Whether a line could be the title of a page: few words, no end of a sentence, no list mark."""
    if tok[-1:] in ".!?,;:“\"" or not 1 < len(_words(tok)) <= 9 or _NO_TITLE.search(raw.strip()) or tok.split()[-1] in OPEN_END:
        return False
    return (raw[:1].isupper() or raw[:1].isdigit()) and not _NUMBERED.match(raw) or raw[:1] in "»›"


def _heading_mark(raw: str) -> bool:
    return bool(_HEAD.match(raw))


def _shape(raw: str, tok: str) -> int:
    if _heading_mark(raw):
        return align.HEADING
    return align.TITLE if _headline(raw, tok) else align.PROSE if _sentence(raw) else align.OTHER


class Site:
    """What is known of a page's site: its wrapper, and the items that its constants are made of."""

    def __init__(self, tokens: list[int] = (), support: list[int] = (), opens: list[bool] = (), items: list[int] = ()):
        self.nodes = (tokens, support, opens)
        self.items = {t & ~7 for t in tokens} | set(items)


class Words:
    """Fixed words of furniture, to judge the lines that no wrapper decides."""

    def __init__(self, pool: frozenset[int] = frozenset(), lists: bool = True):
        _, notice, appeal, reader, _, _ = _tools()
        never = re.compile(r"(?!)")
        self.pool, self.lists = pool, lists
        self.notice, self.appeal, self.reader, self.own = (notice, appeal, reader, OWN_ITEM) if lists else (never,) * 4
        self.teasers = frozenset(_flat(TEASER).split("|")) if lists else frozenset()
        self.items = (frozenset(_flat(NAV).split("|")) | frozenset(_flat(BAR).split("|")) if lists else frozenset()) | self.teasers

    def noticed(self, lines: list[str]) -> list[bool]:
        """Whether a line may match ``notice``: a wider form of it, searched in all lines at once by RE2."""
        wide = re.sub(r"\\b", "", re.sub(r"\\[wd]", ".", self.notice.pattern))
        return pc.match_substring_regex(pa.array(lines, pa.string()), wide).to_pylist() if self.lists else [False] * len(lines)

    def item(self, x: str) -> bool:
        return x in self.items or digest(x) in self.pool


def furniture(raws: list[str], own: Site, words: Words, noticed: list[bool]) -> list[int]:
    """Numbers of the non-blank lines outside the main body, given all lines in plain form and which of them ``words`` noticed.

    The page is aligned with the wrapper of its site: lines that are nodes, titles of a group that a
    node opens and trails that begin with a node are furniture; all else is text of slots, which
    is the body, but for lines that the items of other sites' wrappers, fixed words or
    their form give away.
    """
    notice, appeal, reader, item = words.notice, words.appeal, words.reader, words.item
    toks = [_token(r) for r in raws]
    live = [i for i, r in enumerate(raws) if r]
    order = {i: k for k, i in enumerate(live)}
    shapes = [_shape(raws[i], toks[i]) for i in live]
    on_wrapper, heads = align.parse(*own.nodes, [digest(toks[i]) | s for i, s in zip(live, shapes)]) if own.items else ((), ())
    nodes, opening = {live[k] for k in on_wrapper}, {live[k] for k in heads}
    known = {i for i in live if i in nodes or item(toks[i])}
    heading = {i for i, s in zip(live, shapes) if s == align.HEADING}
    title = {i for i, s in zip(live, shapes) if s == align.TITLE}
    sentence = {i for i, s in zip(live, shapes) if s == align.PROSE}
    sentence |= {i for i in heading | title if _sentence(raws[i])}

    def covered(t: str) -> float:
        """Share of the words of a line that known items make up."""
        n, hit = 0, 0
        for p in pieces(t):
            w = p.split()
            n += len(w)
            if item(p) or digest(p) in own.items:
                hit += len(w)
                continue
            i = 0
            while i < len(w):
                k = next((k for k in range(min(5, len(w) - i), 0, -1) if item(" ".join(w[i : i + k]).strip(":,"))), 0)
                hit += k
                i += k or 1
        return hit / n if n else 0.0

    def near(i: int) -> bool:
        """Whether a line beside line ``i`` is known; a single word alone may be an entry of a list."""
        return any(live[k] in known for k in (order[i] - 1, order[i] + 1) if 0 <= k < len(live))

    def trail(i: int) -> bool:
        """Whether a line is a node with more behind it, or leads over nodes to a title."""
        cuts = [m.span() for m in _TRAIL.finditer(toks[i])]
        if any(digest(toks[i][:a].rstrip(" :")) in own.items for a, _ in cuts[-3:] if a):
            return True
        parts = [toks[i][a:b] for a, b in zip([0, *(b for _, b in cuts)], [a for a, _ in cuts])]
        return len(parts) > 1 and 2 * sum(digest(p) in own.items or item(p) for p in parts) > len(parts)

    out: set[int] = set()
    for i in live:
        t, r = toks[i], raws[i]
        if i in nodes and (" " in t or item(t) or near(i)):
            out.add(i)
            continue
        if i in heading:
            continue
        prose = i in sentence
        if not prose and own.items and trail(i):
            out.add(i)
        elif noticed[i] and notice.search(r) and not (prose and len(_words(r)) > 14 * len(notice.findall(r)) and not reader.search(r) and "©" not in r):
            out.add(i)
        elif reader.search(r) and appeal.search(r) and len(appeal.findall(r)) * 12 >= len(_words(r)) - 8:
            out.add(i)
        elif item(t) or words.own.match(t):
            out.add(i)
        elif not prose and "#" not in t and len(pieces(t)) + len(t.split()) > 2 and covered(t) >= 0.5:
            out.add(i)
        elif not prose and re.search(r"\s[›»>/]\s", r) and covered(pieces(t)[0]) + (digest(pieces(t)[0]) in own.items) > 0.3:
            out.add(i)
        elif not prose and "#" not in t and len(pieces(t)) >= 3 and len(t.split()) <= 3 * len(pieces(t)) and any(map(item, pieces(t))):
            out.add(i)

    # Runs of short lines among which are items of menus: those between them, and at a page's start
    # a few at the ends, are the site's own items.
    def short(i: int) -> bool:
        return len(toks[i].split()) <= 3 and i not in heading and not re.search(r"[.!?,;]$|[;|()\t\d]|\s{3,}", raws[i])

    k = 0
    while k < len(live):
        j = k
        while j < len(live) and short(live[j]):
            j += 1
        run = live[k:j]
        found = [n for n, i in enumerate(run) if (i in known or words.own.match(toks[i])) and toks[i] not in words.teasers and i not in opening]
        if len(found) >= 2 or found and len(run) == 2:
            a, b = found[0], found[-1]
            if k == 0:
                a, b = (0 if a <= 4 else a), (len(run) - 1 if len(run) - 1 - b <= 3 else b)
            marks = {raws[run[n]][:1] for n in found}
            gaps = [y - x for x, y in zip(found, found[1:])]
            if max(gaps, default=1) <= 6 or k == 0 and len(found) * 4 >= b - a + 1:
                out.update(i for i in run[a : b + 1] if raws[i][:1] in marks or raws[i][:1].isalnum() and any(m.isalnum() for m in marks))
        k = max(j, k + 1)
    # Teasers: what follows their heading up to the first line that can't be a title.
    text = " ".join(raws[i] for i in live if i not in out and i in sentence).lower()

    def of_text(i: int) -> bool:
        """Whether the nouns of a headline occur in the page's prose."""
        nouns = [w.lower()[: max(4, len(w) - 2)] for w in _words(toks[i]) if w[0].isupper() and len(w) > 3]
        return any(n in text for n in nouns[-2:])

    for k, i in enumerate(live):
        r = raws[i]
        rest = live[k + 1 :]
        if not (i in opening or toks[i] in words.teasers or toks[i].partition(":")[0] in words.teasers):
            if i in heading or len(toks[i].split()) > 6 or not (i in title or r.endswith(":") and len(toks[i].split()) > 1 and r[:1].isalpha()):
                continue
            n = next((n for n, x in enumerate(rest) if x not in title or x in out), len(rest))
            quoted = any(raws[x].startswith(("»", "›", "→", "➤")) for x in rest[:n])
            if not (n >= 2 and quoted or n >= 3 and text and len(toks[i].split()) <= 4 and not any(of_text(x) for x in rest[: n - 1])):
                continue
        first = True
        for n, x in enumerate(rest):
            after = rest[n + 1] if n + 1 < len(rest) else None
            if x not in title or after is not None and raws[after][:1].islower():
                break
            if not first and after is not None and after not in out and after in sentence and of_text(x) and not raws[x].startswith("»"):
                break
            out.add(x)
            first = False
        out.add(i)
    # A trail repeats the menu before the page's title.
    for i in live:
        if i not in out and i not in sentence and re.search(r"\s[›>/»]\s", raws[i]) and len(pieces(toks[i])) >= 3:
            out.add(i)
    # Without a line of an article's form nothing is left of the page.
    rest = [i for i in live if i not in out]
    if len(rest) * 4 <= len(live) and len(rest) <= 3 and not any(i in sentence or re.search(r"\t|\s{3,}|\||^[-*•–]", raws[i]) for i in rest):
        out |= set(rest)
    return sorted(out)


STREAM = "site string, h long, lines int, tokens array<long>, parts array<array<long>>"
WRAPPER = "site string, pages int, part int, tokens array<long>, support array<int>, repeats array<int>, framed array<int>, opens array<int>, items array<array<long>>"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of pages: tokens as numbers, and for lines of several items (but prose) the items' numbers."""
    for b in batches:
        rows = []
        for url, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not (host := site(url)):
                continue
            tokens, parts = [], []
            for raw in map(plain, text.split("\n")):
                if raw:
                    tok = _token(raw)
                    kind = _shape(raw, tok)
                    own = pieces(tok) if kind != align.PROSE else []
                    tokens.append(digest(tok) | kind)
                    parts.append([digest(x) for x in own if re.search(r"[^\W\d_]{2}", x)] if len(own) > 1 else None)
            rows.append((host, xxhash.xxh3_64_intdigest(repr(tokens)) - (1 << 63), len(tokens), tokens, parts))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 5, (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))))], ["site", "h", "lines", "tokens", "parts"])


def _row(host: str | None, part: int, w: align.Wrapper, items: dict[int, list[int]]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    lists = [pa.array([x], pa.list_(k)) for x, k in zip((w.tokens, w.support, w.repeats, w.framed, w.opens), kinds)]
    return pa.table([pa.array([host], pa.string()), pa.array([w.pages], pa.int32()), pa.array([part], pa.int32()), *lists, pa.array([[items.get(t & ~align.STRONG) for t in w.tokens]], pa.list_(pa.list_(pa.int64())))], ["site", "pages", "part", "tokens", "support", "repeats", "framed", "opens", "items"])


def _infer(pages: pa.Table) -> pa.Table:
    """Wrapper of one group of a site's pages."""
    streams = sorted(pages["tokens"].to_pylist())
    items = {t & ~align.STRONG: p for ts, ps in zip(pages["tokens"].to_pylist(), pages["parts"].to_pylist()) for t, p in zip(ts, ps) if p and align.known(t)}
    return _row(pages["site"][0].as_py(), pages["part"][0].as_py(), align.infer(streams), items)


def _merge(groups: pa.Table) -> pa.Table:
    """One wrapper of up to ``BUCKET`` of a site."""
    rows = sorted(groups.to_pylist(), key=lambda r: r["part"])
    parts = [align.Wrapper(r["tokens"], r["support"], r["repeats"], r["framed"], r["opens"], r["pages"]) for r in rows]
    items = {t & ~align.STRONG: p for r in rows for t, p in zip(r["tokens"], r["items"]) if p}
    w = align.merge(parts).kept(2) if len(parts) > 1 else parts[0]
    return _row(rows[0]["site"], rows[0]["part"] // BUCKET, w, items)


def wrappers(pages: DataFrame, url: str, text: str) -> DataFrame:
    """``site, tokens, support, opens, items``: the wrapper of each site with at least two different pages.

    Only numbers travel: a page is its lines' digests. Pages with equal streams are one page, as copies
    show no constants. A token is a constant of its site if at least two pages and the share ``SUPPORT``
    hold it, and a candidate from two pages and the share ``LEAST`` on; all other lines are left as
    bare shapes. Then the pages of a site are aligned in groups of about ``BUCKET``, and the
    groups' wrappers in rounds of as many, so no task holds more than that of any site.
    Sites of a hundredth of all pages or more are salted in the join.
    """
    seen = pages.select(F.col(url), F.col(text)).mapInArrow(_streams, STREAM)
    distinct = checkpointed(seen.groupBy("site", "h").agg(F.first("lines").alias("lines"), F.first("tokens").alias("tokens"), F.first("parts").alias("parts")))
    sizes = checkpointed(distinct.groupBy("site").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).filter("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shares = lambda df: df.join(F.broadcast(sizes.filter(F.col("n") >= HOT * total).select("site", F.ceil(F.lit(64) * F.col("n") / F.lit(total)).cast("int").alias("shares"))), "site", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    tokens = distinct.select("site", F.explode(F.array_distinct("tokens")).alias("t")).groupBy("site", "t").agg(F.count("*").alias("df")).filter("df > 1")
    large = F.broadcast(sizes.filter(F.col("n") >= HOT * total).select("site", F.col("n").alias("_n")))
    tokens = tokens.join(large, "site", "left").filter(F.col("_n").isNull() | (F.col("df") >= LEAST * F.col("_n"))).drop("_n").join(sizes, "site")
    tokens = tokens.filter(F.col("df") >= LEAST * F.col("n")).groupBy("site", "n", "lines").agg(F.collect_list(F.when(F.col("df") >= SUPPORT * F.col("n"), F.col("t"))).alias("strong"), F.collect_list(F.when(F.col("df") < SUPPORT * F.col("n"), F.col("t"))).alias("weak"))
    tokens = tokens.withColumn("buckets", F.greatest(F.ceil(F.col("n") / BUCKET), F.ceil(F.col("lines") / BUCKET_LINES)).cast("int")).drop("n", "lines")
    tokens = checkpointed(shares(tokens).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares"))
    groups = tokens.agg(F.max("buckets")).first()[0] or 0
    salted = shares(distinct.select("site", "h", "tokens", "parts")).withColumn("salt", F.pmod("h", F.col("shares")).cast("int")).drop("shares")
    marked = salted.join(tokens, ["site", "salt"]).select(
        "site", F.pmod(F.shiftright("h", 16), F.col("buckets")).cast("int").alias("part"),
        F.transform("tokens", lambda t: F.when(F.array_contains("strong", t), t.bitwiseOR(F.lit(align.STRONG).cast("long"))).when(F.array_contains("weak", t), t).otherwise(t.bitwiseAND(F.lit(3).cast("long")))).alias("tokens"), "parts",
    )
    found = marked.groupBy("site", "part").applyInArrow(_infer, WRAPPER)
    while groups > 1:
        found = found.groupBy("site", F.floor(F.col("part") / BUCKET).alias("group")).applyInArrow(_merge, WRAPPER)
        groups = -(-groups // BUCKET)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                w = align.Wrapper(r["tokens"], r["support"], r["repeats"], r["framed"], r["opens"], r["pages"])
                tokens, support, opens = align.settled(w)
                left = set(tokens)
                out.append((r["site"], tokens, support, opens, sorted({x for t, p in zip(r["tokens"], r["items"]) if p and t & ~align.STRONG in left for x in p})))
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, kinds)], ["site", "tokens", "support", "opens", "items"])

    return checkpointed(found.mapInArrow(settle, "site string, tokens array<long>, support array<int>, opens array<boolean>, items array<long>").filter(F.size("tokens") > 0))


def shared_items(found: DataFrame) -> frozenset[int]:
    """Digests of the items that the wrappers of at least three sites and the share ``POOL`` of all hold; of single words, ``POOL_WORD``.

    There are at most (items a site) / ``POOL``, which bounds what is collected and sent to the tasks.
    """
    sites = found.count()
    lines = F.transform("tokens", lambda t: t.bitwiseAND(F.lit(~7).cast("long")))
    counts = found.select(F.explode(F.array_distinct(F.concat(lines, "items"))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    several = F.col("item").bitwiseAND(F.lit(8).cast("long")) > 0
    return frozenset(r[0] for r in counts.filter(F.col("n") >= F.when(several, max(3.0, POOL * sites)).otherwise(max(3.0, POOL_WORD * sites))).select("item").toLocalIterator())


def map_pages(pages: DataFrame, key: str, url: str, text: str, row: Callable[[object, list[str], list[int]], tuple], schema: str, kinds: list[pa.DataType], lists: bool = True) -> DataFrame:
    """``row(key, lines, outside)`` of every page with a key and a text, repeated rows too; see ``page_lines``.

    Texts move once, to the wrapper of their site. The wrappers of sites with the share ``HOT`` of all rows are
    sent to all tasks; rows of these and of unknown sites are dealt out by their number.
    """
    usable = pages.filter(F.col(key).isNotNull() & F.col(text).rlike(r"\S"))
    found = wrappers(usable, url, text)
    pool = shared_items(found)
    rows = usable.select(F.col(key).alias("key"), F.col(text).alias("text"), _host(F.col(url)).alias("site"))
    spark = pages.sparkSession
    counts = checkpointed(rows.groupBy("site").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in counts.filter(F.col("site").isNotNull() & (F.col("count") >= HOT * total)).collect()]
    known = {r[0]: r[1:] for r in found.filter(F.col("site").isin(hot)).collect()} if hot else {}
    shared = spark.sparkContext.broadcast((pool, known))
    dealt = F.concat(F.lit("#"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    alone = F.col("site").isNull() | F.col("site").isin(hot) if hot else F.col("site").isNull()
    rows = rows.withColumn("at", F.when(alone, dealt).otherwise(F.col("site"))).repartition(width(spark), "at")
    joined = rows.join(found.withColumnRenamed("site", "at"), "at", "left").select("key", "text", "site", "tokens", "support", "opens", "items")
    names = [f.split()[0] for f in schema.split(", ")]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, known = shared.value
        words, sites = Words(pool, lists), {s: Site(*x) for s, x in known.items()}
        none, last = Site(), (None, Site())
        for b in batches:
            out = []
            plains = [[plain(x) for x in t.split("\n")] for t in b.column(1).to_pylist()]
            noticed = iter(words.noticed([x for p in plains for x in p]))
            for k, t, s, *x, p in zip(*(b.column(c).to_pylist() for c in range(7)), plains):
                own = sites.get(s, none)
                if x[0] is not None:
                    last = last if last[0] == s else (s, Site(*x))
                    own = last[1]
                out.append(row(k, t.split("\n"), furniture(p, own, words, list(islice(noticed, len(p))))))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [[]] * len(names), [b.schema.field(0).type, *kinds])], names)

    return joined.mapInArrow(label, schema)


def page_lines(pages: DataFrame, key: str, url: str, text: str, lists: bool = True) -> DataFrame:
    """``key, text, outside``: each distinct page with the numbers of its lines outside the main body.

    ``outside`` numbers lines from 0, blank lines included in the numbering but never listed. Rows
    with a null, empty or blank text, or a null key, have no row; repeated rows count once. A
    page of an unknown site (null or unreadable URL) or of a site with one page is judged by what
    the wrappers of other sites have in common.

    The wrapper of each site (``wrappers``) is matched against its pages; what lies in its slots is
    the body. Lines of slots are outside only if items of other sites' wrappers, fixed words (none if not
    ``lists``) or their form say so.
    """
    kind = pages.schema[key].dataType.simpleString()
    out = map_pages(pages, key, url, text, lambda k, lines, outside: (k, "\n".join(lines), outside), f"key {kind}, text string, outside array<int>", [pa.string(), pa.list_(pa.int32())], lists)
    return out.withColumn("_d", F.xxhash64("text")).dropDuplicates(["key", "_d"]).drop("_d").withColumnRenamed("key", key)


def outside_lines(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """``key, line_no``: the lines of ``page_lines`` that are outside the main body, one row each."""
    kind = pages.schema[key].dataType.simpleString()
    out = map_pages(pages, key, url, text, lambda k, _, outside: (k, outside), f"key {kind}, outside array<int>", [pa.list_(pa.int32())])
    return out.select(F.col("key").alias(key), F.explode("outside").alias("line_no")).distinct()
