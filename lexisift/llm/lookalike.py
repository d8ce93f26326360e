"""One form for texts that look the same but differ in their characters."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisift.session import checkpointed

# Letters of other scripts with the shape of a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "ӏ": "l", "Ӏ": "I", "ѵ": "v", "Ѵ": "V", "ү": "y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j", "ɡ": "g", "ɑ": "a",
    "օ": "o", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "Ս": "U", "Տ": "S", "ց": "g", "զ": "q", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W",
    "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏻ": "G", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "‐": "-", "‑": "-",
}
# Characters that are their own form, whatever stands before them: the body of nearly all texts.
PLAIN = r"\t\n\r -~¡-§©«¬®-±»¿-ıĴ-ƿǍ-ɏ–—‘-‟•…‰′″‹›€"


def _own(c: str) -> str:
    """Form of one character before decomposition: width, ligatures, blanks, invisible ones."""
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if kind == "Cf" or kind == "Cc" and c not in "\t\n\r\x85" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or c in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    tag = unicodedata.decomposition(c).partition(" ")[0]
    name = unicodedata.name(c, "") if tag == "<compat>" else ""
    if tag in ("<wide>", "<narrow>", "<noBreak>") or name.startswith(("LATIN SMALL LIGATURE", "LATIN CAPITAL LIGATURE")) or "ROMAN NUMERAL" in name:
        return unicodedata.normalize("NFKC", c)
    return c


@lru_cache(1)
def mapping() -> list[tuple[str, list[tuple[str, int]]]]:
    """(character, its parts with their combining classes) for all that are not one own part of class 0.

    Made by rule from the Unicode database; about 14,000 entries, most of them Hangul syllables.
    """
    out = []
    for n in range(sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        if n > 0x323AF and not 0xE0000 <= n < 0xE1000 or unicodedata.category(c) in ("Cn", "Co"):
            continue
        parts = unicodedata.normalize("NFD", _own(c))
        parts = "".join(LOOKALIKES.get(p, p) for p in parts)
        if parts != c or unicodedata.combining(c):
            out.append((c, [(p, unicodedata.combining(p)) for p in parts]))
    return out


@lru_cache(1)
def compositions() -> dict[str, str]:
    """Pair of characters -> the one that stands for both (Hangul stays decomposed)."""
    out = {}
    for n in range(0xC0, 0x1D1C1):
        c = chr(n)
        two = unicodedata.decomposition(c)
        if two and two[0] != "<" and " " in two and unicodedata.normalize("NFC", c) == c:
            out["".join(chr(int(x, 16)) for x in two.split())] = c
    return out


def _compose(marks: Column, pairs: Column) -> Column:
    """Canonical composition of one starter with its marks: an array of structs (c, ccc) in canonical order.

    The state is the starter, the marks behind it that didn't compose and the class of the last
    of them, which blocks marks of no higher class. The first mark of a text that begins with
    marks stands in for a starter.
    """
    start = F.struct(F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        made = F.when((a["base"] != "") & ((a["rest"] == "") | (a["last"] < x["ccc"])), F.try_element_at(pairs, F.concat(a["base"], x["c"])))
        return (
            F.when(a["base"] == "", F.struct(x["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last")))
            .when(made.isNotNull(), F.struct(made.alias("base"), a["rest"].alias("rest"), a["last"].alias("last")))
            .otherwise(F.struct(a["base"].alias("base"), F.concat(a["rest"], x["c"]).alias("rest"), x["ccc"].alias("last")))
        )

    return F.aggregate(marks, start, step, lambda a: F.concat(a["base"], a["rest"]))


def _plain_is_own() -> bool:
    """Whether no character of ``PLAIN`` has a mapping (checked in tests)."""
    import re

    return not [c for c, parts in mapping() if parts != [(c, 0)] and re.match(f"[{PLAIN}]", c) and "".join(p for p, _ in parts) != unicodedata.normalize("NFD", c)]


def same_look(texts: DataFrame, text: str = "text") -> DataFrame:
    """``digest, form`` for every distinct non-null ``text``: its SHA-256 and its form.

    Texts have equal forms if they differ only in characters that look alike: the kind of blank,
    full or half width, invisible characters, order and composition of accents, ligatures,
    letters of other scripts with a Latin shape. Case, accents, digits, raised digits, line
    breaks, quotation marks and the length of dashes stay. The form is composed (NFC), but for
    Hangul, which is written in its parts. An empty text has an empty form; null texts have no row.

    Texts meet once by digest; all later steps keep that layout, so nothing else is shuffled. Only
    the runs of a text that hold other than plain characters are exploded to code points, joined
    with the broadcast mapping (a fixed table of about 14,000 rows), ordered by class,
    recomposed and put back between the plain runs.
    """
    spark = texts.sparkSession
    maps = F.broadcast(spark.createDataFrame(mapping(), "ch string, parts array<struct<c:string,ccc:int>>"))
    pairs = F.from_json(F.lit(json.dumps(compositions(), ensure_ascii=False)), "map<string,string>")
    docs = texts.select(F.sha2(F.col(text).cast("binary"), 256).alias("digest"), F.col(text).alias("_text")).filter("_text is not null").dropDuplicates(["digest"])
    runs = rf"[{PLAIN}]*[{PLAIN}](?![^{PLAIN}])|[{PLAIN}]?[^{PLAIN}]+"
    docs = docs.withColumn("runs", F.regexp_extract_all("_text", F.lit(runs), F.lit(0))).drop("_text")
    odd = docs.select("digest", F.posexplode("runs").alias("run", "odd")).filter(F.col("odd").rlike(f"[^{PLAIN}]"))
    points = odd.select("digest", "run", F.posexplode(F.split("odd", "")).alias("pos", "ch")).filter("ch <> ''")
    points = points.join(maps, "ch", "left")
    one = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))
    points = points.select("digest", "run", "pos", F.posexplode_outer(F.coalesce("parts", one)).alias("sub", "part"))
    points = points.select("digest", "run", "pos", "sub", F.coalesce("part.c", F.lit("")).alias("c"), F.coalesce("part.ccc", F.lit(0)).alias("ccc"))
    # The number of starters so far keeps a mark with its starter; the sort then orders marks by class.
    starter = ((F.col("ccc") == 0) & (F.col("c") != "")).cast("int")
    points = points.withColumn("at", F.sum(starter).over(Window.partitionBy("digest", "run").orderBy("pos", "sub")))
    clusters = points.filter("c <> ''").groupBy("digest", "run", "at").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "c"))).alias("marks"))
    clusters = clusters.withColumn("s", F.when(F.size("marks") == 1, F.element_at("marks", 1)["c"]).otherwise(_compose(F.col("marks"), pairs)))
    # Runs whose characters are all invisible have no cluster and become empty.
    forms = clusters.groupBy("digest", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("form"))
    forms = forms.select("digest", F.struct("run", "form").alias("made"))
    forms = forms.groupBy("digest").agg(F.map_from_entries(F.collect_list("made")).alias("made"))
    rebuilt = F.array_join(F.transform("runs", lambda r, i: F.when(r.rlike(f"[^{PLAIN}]"), F.coalesce(F.try_element_at("made", i), F.lit(""))).otherwise(r)), "")
    return docs.join(forms, "digest", "left").select("digest", rebuilt.alias("form"))


def _members(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """``group, id, digest, form`` of each distinct record with a form that is not blank; written once, as it is read several times and small."""
    keyed = rows.filter(F.col(text).isNotNull() & F.col(key).isNotNull() & F.col(group).isNotNull())
    keyed = keyed.select(F.col(group).alias("group"), F.col(key).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("digest"))
    forms = same_look(rows, text).filter(F.col("form").rlike(r"(?U)\S")).select("digest", F.sha2(F.col("form").cast("binary"), 256).alias("form"))
    return checkpointed(keyed.distinct().join(forms, "digest").select("group", "id", "digest", "form"))


def look_classes(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """``group, id, form, members, links``: each distinct record with the class of texts that look like its own.

    ``form`` names the class (SHA-256 of the common form), which has ``members`` records; ``links`` of them
    have another text than this one. So the pairs of ``look_pairs`` are told without listing them: their
    number is half the sum of ``links``. Null, empty and blank texts and null keys have no row; a record
    with two texts has a row for each.

    Records are counted before they are shuffled. Counts of texts that a hundredth of all records share are
    broadcast (at most 100), so no group of copies meets in one task.
    """
    member = _members(rows, group, key, text)
    texts = checkpointed(member.groupBy("group", "form", "digest").agg(F.count("*").alias("same")))
    sizes = texts.groupBy("group", "form").agg(F.sum("same").alias("members"))
    counts = checkpointed(texts.join(sizes, ["group", "form"]).select("group", "digest", "members", (F.col("members") - F.col("same")).alias("links"), "same"))
    total = counts.agg(F.sum("same")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("same") >= 0.01 * total).select("group", "digest", F.col("members").alias("m"), F.col("links").alias("l")))
    marked = member.join(hot, ["group", "digest"], "left")
    cold = marked.filter("m is null").drop("m", "l").join(counts.drop("same"), ["group", "digest"])
    warm = marked.filter("m is not null").withColumnsRenamed({"m": "members", "l": "links"})
    columns = ["group", "id", "form", "members", "links"]
    return cold.select(columns).unionByName(warm.select(columns))


def look_pairs(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """``group, id_a, id_b`` (``id_a`` < ``id_b``) of records of a group whose texts look the same but differ.

    Rows that repeat a record count once; null, empty and blank texts (by their form) form no
    pairs, nor does a record with a null ``group`` or ``key``. The pairs are the asked-for result;
    they are made within sets of equal form that hold more than one text, joined on digests
    (SHA-256), not on texts, and a skewed set is split by AQE. Where groups of copies are large, ``look_classes`` tells the same without listing pairs.
    """
    member = _members(rows, group, key, text)
    # First the pairs of different texts, then their records: copies of one text are never compared with each other.
    texts = member.select("group", "form", "digest").distinct()
    several = texts.groupBy("group", "form").agg(F.count("*").alias("n")).filter("n > 1").select("group", "form")
    texts = texts.join(several, ["group", "form"], "left_semi")
    a, b = texts.withColumnRenamed("digest", "one"), texts.withColumnRenamed("digest", "two")
    pairs = a.join(b, ["group", "form"]).filter(F.col("one") < F.col("two")).select("group", "one", "two")
    pairs = pairs.join(member.select("group", F.col("digest").alias("one"), F.col("id").alias("x")), ["group", "one"])
    pairs = pairs.join(member.select("group", F.col("digest").alias("two"), F.col("id").alias("y")), ["group", "two"]).filter("x <> y")
    return pairs.select("group", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
