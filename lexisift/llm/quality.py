"""Text statistics, their exact ranks, outlier scores, and the form of texts that aren't prose."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisift.llm.pairs import FUNCTION_WORDS, language
from lexisift.llm.wrapper import OPEN_END, plain
from lexisift.session import balanced, checkpointed, width

#: Statistics and the tails that point away from prose: -1 low, 1 high, 0 both.
STATISTICS = {"words": 0, "word_length": 0, "symbol_share": 1, "digit_share": 1, "ended_lines": -1, "common_share": -1, "line_words": -1, "distinct_words": -1}
#: Statistics of the looks of a text's lines, and the form that each gives away.
LOOKS = {"entry_share": "list", "row_share": "table", "noise_share": "junk", "repeated_share": "junk"}
#: Share of a text's signs in lines of one look up to which it is a short list, a small table or some garbage in prose.
SHORT = 0.25
#: Shares of looks are rounded to this step, so there are at most 1 / STEP values of each.
STEP = 0.001

#: Words of a run whose distinct words are counted.
WINDOW = 200

# Fixed value: what marks an entry of a list.
MARK = r"([-*•–+>✅➤🔹✔☑▪■□●○◦]|\d{1,3}[.)]|[a-zA-Z][.)](?=\s))"
_COMMON = frozenset(w for v in FUNCTION_WORDS.values() for w in v)


def fresh(words: list[str]) -> float:
    """Share of distinct words in runs of ``WINDOW`` words, on average over all of them.

    Long texts repeat their words anyway, so runs of one length are compared. Each run, a short
    last one too, weighs by its words.
    """
    runs = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
    return sum(len(set(x)) for x in runs) / max(1, len(words))


def statistics(text: str) -> dict[str, float]:
    """Figures of a text with look-alike characters in one form, rounded to six digits."""
    lines = [plain(x) for x in text.split("\n")]
    lines = [x for x in lines if x]
    words = re.findall(r"\w+", " ".join(lines).lower())
    signs = [c for x in lines for c in x if not c.isspace()]
    n = max(1, len(words))
    out = {
        "words": len(words),
        "word_length": sum(map(len, words)) / n,
        "symbol_share": sum(not c.isalnum() for c in signs) / max(1, len(signs)),
        "digit_share": sum(c.isdigit() for c in signs) / max(1, len(signs)),
        "ended_lines": sum(bool(re.search(r"[.!?…:][\"”“»)]*$", x)) for x in lines) / max(1, len(lines)),
        "common_share": sum(w in _COMMON for w in words) / n,
        "line_words": len(words) / max(1, len(lines)),
        "distinct_words": fresh(words),
    }
    return {k: round(float(v), 6) for k, v in out.items()}


def spoken_language(text: str) -> str | None:
    """Language by function words; None where hardly a word is one."""
    best, share = language(text)
    return best if share[best] >= 0.05 else None


_GARBLED = re.compile(r"[�\x80-\x9f]|[ÃÂ€¤¶¼¢]")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_LETTER = re.compile(r"[^\W\d_]")
# Signs, or digits beside letters, in the midst of a word.
_INSIDE = re.compile(r"[0-9!\"§|;,.^<>=]|[^\W\d_]['’:][^\W\d_]{3}")
_MACHINE = re.compile(r"\b0x[0-9a-fA-F]{2,}\b|\w::\w|\w\.\w+\(.*\);|\)\s*\{.*\}\s*$")
_SIGNS = re.compile(r"[~^<>@#&*\\_%]")
_FRAME = re.compile(r"[|!{}+=-][|!{}+=\s-]*")
_COLUMNS = re.compile(r"\S\s{3,}(?=\S)")
_FIGURES = re.compile(r"^\S[^:]{0,40}[:=]\s*[\d.,]+\s*([/|;]\s*[\d.,]+\s*)*$")
_NUMBER, _LONGER = re.compile(r"(?<!\w)\d[\d.,]*(?!\w)"), re.compile(r"[^\W\d]{2,}")
_MARKED = re.compile(MARK + r"\s*\S")
_MARK = re.compile(MARK)
_STOP = re.compile(r"[.!?:…][\"”“»]*$")
_LETTERS, _BLANKS, _WORDS = re.compile(r"[^\W\d_]+"), re.compile(r"\s"), re.compile(r"\w+")
_UNBROKEN, _TWO = re.compile(r"\S{40,}"), re.compile(r"[^\W\d_]{2,}")
_RARE = re.compile(r"[bcdfghjklmnpqrstvwxzß]{6,}|q(?!u)|[bcdfghjklmnpqrstvwxz]{5,}$|^[bcdfgjklmnpqrtvwxz]{4,}|[aeiouäöüy]{4,}|j[kqxz]|[zwf]j|ö[öäü]")
_HEADING = re.compile(r"(#{1,6}|={2,6})\s")


def _garbled(word: str) -> bool:
    return bool(_GARBLED.search(word))


@lru_cache(4096)
def _misread(line: str) -> bool:
    """Whether a line is text with wrong signs in the midst of its words, as of a bad scan."""
    count, odd = 0, []
    for x in line.split():
        y = x.strip(".,;:!?\"„“”()")
        if y.isalpha():
            count += len(y) > 2
        elif len(t := _OUTER.sub("", x)) > 2:
            count += 1
            odd.append(t)
    if count < 5 or 4 * len(odd) < count:
        return False
    return 4 * sum(bool(_LETTER.search(t) and _INSIDE.search(t)) for t in odd) >= count


def _machine(line: str) -> bool:
    """Whether a line is of a log or a program: addresses, scoped names, calls and blocks."""
    return bool(_MACHINE.search(line))


@lru_cache(4096)
def _row(line: str) -> bool:
    """Whether a line is a row of fields or values."""
    s = line.strip()
    if _misread(s) or _machine(s) or len(_SIGNS.findall(s)) >= 3:
        return False
    if _FRAME.fullmatch(s) or s.startswith(("|", "!")) and s.count("|") + s.count("!") >= 2:
        return True
    if s.count(";") >= 2 and "; " not in s and not re.search(r";\s", s) or "\t" in s or s.count("|") >= 2 or "   " in s and len(_COLUMNS.findall(s)) >= 2:
        return True
    return bool(_FIGURES.match(s)) or len(_NUMBER.findall(s)) >= 3 and len(_LONGER.findall(s)) <= 3


def _entry(line: str) -> bool:
    """Whether a line is an entry of a list."""
    s = line.strip()
    if _MARKED.match(s):
        return True
    return len(s.split()) <= 7 and not _STOP.search(s) and bool(_TWO.search(s))


@lru_cache(4096)
def _noise(line: str) -> bool:
    """Whether a line is garbled, encoded or machine text."""
    s = line.strip()
    if _misread(s) or _machine(s):
        return True
    words = _LETTERS.findall(s)
    letters = sum(map(len, words))
    signs = len(_BLANKS.sub("", s))
    if not signs or letters * 2 < signs and 2 * sum(map(str.isdigit, s)) < signs or _UNBROKEN.search(s):
        return True
    if _GARBLED.search(s):
        tokens = s.split()
        if len(tokens) >= 4 and sum(map(_garbled, tokens)) * 4 >= len(tokens):
            return True
    long = [w.lower() for w in words if len(w) > 3]
    return len(long) >= 3 and 3 * sum(bool(_RARE.search(w)) for w in long) >= len(long)


# What a line of plain prose never has; lines with none of it need no closer look.
_ODD = re.compile(r"\w[!\"§|;,.^<>='’:]\w|\d[^\W\d_]|[^\W\d_]\d|^[!|]|[\t|]|;\S|\s{3}|[:=]\s*[\d.,]+\s*$|\d\D+\d\D+\d|[�\x80-\x9fÃÂ€¤¶¼¢]")
_END = re.compile(r"[.!?…][\"”“»)]*(\s|$)")


def looks(lines: list[str]) -> dict[str, float]:
    """Shares of a body's signs that stand in lines of each look; lines in doubt are judged by the function words in them.

    ``repeated_share`` is the share of words in runs of five words that occur three times or more, or
    that one word has over a few others. Headings count for nothing. Shares up to ``SHORT`` and lists of one or two
    entries are 0.
    """
    raw = [x for x in lines if x.strip()]
    clean = [plain(x) if "\t" not in x else x for x in raw]
    words = _WORDS.findall(" ".join(clean).lower())
    # A sentence broken over several lines is put together before it is judged.
    blocks: list[str] = []
    before = ""
    for c in clean:
        open_end = before and not _STOP.search(before) and not _MARK.match(c) and not _row(before) and not _row(c)
        if open_end and (c[:1].islower() or before.split()[-1] in OPEN_END or len(before.split()) > 4 and len(c.split()) > 2) and not _noise(blocks[-1]):
            blocks[-1] += " " + c
        else:
            blocks.append(c)
        before = c
    weight: Counter = Counter()
    for b in blocks:
        kind = _look(b)
        weight[kind] += len(_BLANKS.sub("", b))
        weight[f"{kind} lines"] += 1
    total = sum(weight[k] for k in ("prose", "list", "table", "junk")) or 1
    # One short line is a title or a remark, not a list.
    if weight["list lines"] < 3:
        weight["list"] = 0
    shares = {"entry_share": weight["list"] / total, "row_share": weight["table"] / total, "noise_share": weight["junk"] / total, "repeated_share": _repeated(words)}
    return {k: round(v, 3) if v > SHORT else 0.0 for k, v in shares.items()}


def _repeated(words: list[str]) -> float:
    """Share of words that only repeat others."""
    if len(words) < 20:
        return 0.0
    (_, top), known = Counter(words).most_common(1)[0], len(set(words))
    if top > 0.4 * len(words) and known <= max(8, 0.1 * len(words)):
        return 1.0
    # By windows, as a long text repeats its words anyway.
    windows = [words[i : i + 100] for i in range(0, max(1, len(words) - 50), 100)]
    if sum(len(set(x)) / len(x) for x in windows) < 0.1 * len(windows):
        return 1.0
    if len(words) < 40 or known == len(words):
        return 0.0
    runs = Counter(zip(words, words[1:], words[2:], words[3:], words[4:]))
    return min(1.0, sum(n for n in runs.values() if n > 2) / len(words))


def _look(b: str) -> str:
    """What a line, or the lines of a sentence, look like: prose, heading, list, table or junk."""
    w = _WORDS.findall(b.lower())
    common = sum(x in _COMMON for x in w) / max(1, len(w))
    sentence = len(w) >= 4 and common >= 0.08 and bool(_END.search(b))
    if sentence and common >= 0.15 and not _ODD.search(b):
        return "prose"
    if _row(b):
        return "table"
    if _misread(b) or _noise(b) and not (sentence and common >= 0.15 and sum(map(_garbled, b.split())) * 4 < len(b.split())):
        return "junk"
    if sentence or common >= 0.18 and len(w) >= 8:
        return "prose"
    if _HEADING.match(b):
        return "heading"
    return "list" if _entry(b) else "prose" if common >= 0.1 else "junk"


def measure(text: str) -> tuple:
    """Language and ``STATISTICS`` of a text."""
    return spoken_language(text), *statistics(text).values()


def inspect(text: str) -> tuple:
    """Language and ``LOOKS`` of a text."""
    return spoken_language(text), *looks(text.split("\n")).values()


def measured(texts: DataFrame, key: str, text: str, by: Callable[[str], tuple], names: Iterable[str]) -> DataFrame:
    """``key, lang`` and the figures ``names`` of each row with a non-blank text."""
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"\S"))
    columns = ["key", "lang", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(by, b.column(1).to_pylist()))) or [[]] * (len(columns) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found[0], pa.string()), *(pa.array(x, pa.float64()) for x in found[1:])], columns)

    return balanced(rows).mapInArrow(run, ", ".join([f"key {rows.schema['key'].dataType.simpleString()}", "lang string", *(f"{k} double" for k in names)]))


def _major(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with unknown languages counted to the most frequent one, and their number."""
    langs = rows.groupBy("lang").count().collect()
    major = max((r for r in langs if r["lang"]), key=lambda r: (r["count"], r["lang"]), default={"lang": "und"})["lang"]
    return rows.withColumn("lang", F.coalesce("lang", F.lit(major))), sum(r["count"] for r in langs)


def _long(rows: DataFrame, names: Iterable[str], *keys: str) -> DataFrame:
    return rows.select(*keys, "lang", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("stat", "value"))


def ranks(values: DataFrame) -> DataFrame:
    """``lang, stat, value, n, below, upto, total``: exact ranks of each distinct value of its group.

    ``below`` rows have less, ``upto`` rows no more than the value, of ``total`` in the group. Equal
    values are added up first, so a frequent value is one row. The distinct values are then sorted
    over range partitions; each partition counts by itself, and starts at the offset that the
    partitions before it leave: one number for a partition and group, which is all the driver sees.
    """
    spark = values.sparkSession
    counts = values.groupBy("lang", "stat", "value").agg(F.count("*").alias("n"))
    ordered = checkpointed(counts.repartitionByRange(width(spark), "stat", "lang", "value").sortWithinPartitions("stat", "lang", "value").withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part", "stat", "lang").agg(F.sum("n").alias("s")).collect()
    total: Counter = Counter()
    for r in sums:
        total[r["stat"], r["lang"]] += r["s"]
    so_far: Counter = Counter()
    offset = {}
    for r in sorted(sums, key=lambda r: r["part"]):
        offset[r["part"], r["stat"], r["lang"]] = so_far[r["stat"], r["lang"]]
        so_far[r["stat"], r["lang"]] += r["s"]
    shared = spark.sparkContext.broadcast((offset, dict(total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, totals = shared.value
        at, group = 0, None
        for b in batches:
            below, upto, whole = [], [], []
            for lang, stat, n, part in zip(*(b.column(c).to_pylist() for c in ("lang", "stat", "n", "part"))):
                if group != (stat, lang):
                    group, at = (stat, lang), offsets[part, stat, lang]
                below.append(at)
                at += n
                upto.append(at)
                whole.append(totals[stat, lang])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("stat"), b.column("value"), b.column("n"), pa.array(below, pa.int64()), pa.array(upto, pa.int64()), pa.array(whole, pa.int64())], ["lang", "stat", "value", "n", "below", "upto", "total"])

    return ordered.mapInArrow(run, "lang string, stat string, value double, n long, below long, upto long, total long")


def tails(low: str, high: str, total: str, side: int) -> F.Column:
    """Tail probability of a value from its ranks."""
    left, right = F.col(high) / F.col(total), (F.col(total) - F.col(low)) / F.col(total)
    return left if side < 0 else right if side > 0 else F.least(2 * F.least(left, right), F.lit(1.0))


def ranked(rows: DataFrame, key: str = "key") -> DataFrame:
    """``key, lang``, the statistics and ``score`` of each row of ``measured`` texts.

    The score adds the negative logarithms of the statistics' tail probabilities in the text's
    language, by exact ranks over all rows; by chance it is about the number of statistics.
    Texts in which hardly a word is a function word are ranked among those of the most frequent
    language, as they have none of their own.

    No text travels. A value that at least one in 200 rows shares has its ranks broadcast (at most 200 a statistic);
    the others are joined by value, so that no frequent value meets in one task.
    """
    rows, total = _major(checkpointed(rows.withColumn("row", F.expr("uuid()"))))
    long = _long(rows, STATISTICS, "row")
    placed = checkpointed(ranks(long.drop("row")))
    often = F.broadcast(placed.filter(F.col("n") >= max(2.0, total / 200)))
    first = long.join(often, ["lang", "stat", "value"], "left")
    on = ["lang", "stat", "value"]
    rest = first.filter("n is null").select("row", *on).join(placed, on)
    known = first.filter("n is not null").select("row", *on, "n", "below", "upto", "total").unionByName(rest.select("row", *on, "n", "below", "upto", "total"))
    tail = F.coalesce(*(F.when(F.col("stat") == k, tails("below", "upto", "total", side)) for k, side in STATISTICS.items()))
    scores = known.groupBy("row").agg(F.round(F.sum(-F.log(tail)), 6).alias("score"))
    return rows.join(scores, "row").drop("row").withColumnRenamed("key", key)


class Tails:
    """Upper tail probabilities of the looks in each language, from exact ranks."""

    def __init__(self, placed: Iterable[tuple[str, str, float, int, int]]):
        found: dict[tuple[str, str], list[tuple[float, float]]] = {}
        for lang, stat, value, below, total in placed:
            found.setdefault((lang, stat), []).append((value, (total - below) / total))
        self.values = {k: tuple(zip(*sorted(v))) for k, v in found.items()}

    def at(self, lang: str, stat: str, value: float) -> float:
        """Share of texts with at least ``value``."""
        values, shares = self.values[lang, stat]
        i = bisect_left(values, value)
        return shares[i] if i < len(shares) else 0.0

    def form(self, lang: str, figures: Iterable[float], half: float = 0.5) -> str | None:
        """The form of a text whose score is beyond that of one with just more than ``half`` of its leading look, else None.

        The score adds the negative logarithms of the looks' tail probabilities.
        """
        parts = {k: -log(self.at(lang, k, v)) if v else 0.0 for k, v in zip(LOOKS, figures)}
        present = [k for k, v in zip(LOOKS, figures) if v]
        if not present:
            return None
        lead = max(present, key=lambda k: parts[k])
        border = self.at(lang, lead, half + STEP / 2)
        return LOOKS[lead] if border and sum(parts.values()) >= -log(border) - 1e-12 else None


def decided(rows: DataFrame, key: str = "key") -> DataFrame:
    """``key, form`` of the texts that are mostly not prose: ``list``, ``table`` or ``junk``; ``rows`` are ``inspect``ed ones.

    Each text has a score: the sum of the negative logarithms of its looks' tail probabilities, by exact ranks
    among all texts of its language. It is an outlier if the score is at least that of a text with more than half
    of its signs in the leading look, which names the form. So a text of one look is judged alike however many others
    share it, and ranks decide where looks meet in one text.

    The ranks of looks have at most 1 / ``STEP`` values a statistic and language, so they are sent to all tasks.
    """
    kind = rows.schema["key"].dataType.simpleString()
    rows, _ = _major(checkpointed(rows.distinct()))
    placed = ranks(_long(rows, LOOKS)).select("lang", "stat", "value", "below", "total").collect()
    shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in placed])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails_of = Tails(shared.value)
        for b in batches:
            found = [tails_of.form(lang, figures) for lang, *figures in zip(*(b.column(c).to_pylist() for c in ("lang", *LOOKS)))]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.string())], ["key", "form"])

    return rows.mapInArrow(decide, f"key {kind}, form string").filter("form is not null").distinct().withColumnRenamed("key", key)


def scored(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, lang``, the statistics and ``score`` of each row with a non-blank text (see ``ranked``); rows with a null or blank text have none."""
    return ranked(measured(texts, key, text, measure, STATISTICS), key)


def not_prose(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, form`` of the texts that are mostly not prose (see ``decided``); rows with a null or blank text have none, repeated rows give one."""
    return decided(measured(texts, key, text, inspect, LOOKS), key)
