"""Readers of text corpora, case files and landed web material; schemas are always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.lexicon import java

CASE = "id string, input string, expected_changes array<string>, expected_unchanged array<string>, domain string, source string, notes string, true_negative boolean"
PATTERN_FILE = "pattern_id int, pattern_name string, lang string, note string, cases array<struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in CASE.split(", ")) + ">>"
END_TO_END = "id string, lang string, domain string, source string, input string, reference_rewrite string"
PROBE = "id string, rep int, cond string, has_commentary boolean, is_fenced boolean, final string"
# Labels of trigger lists in rule packs.
TRIGGER_LABELS = (
    "Words to watch", "Phrases to watch", "Signs to watch", "Tokens to watch", "Trigger words", "Trigger words / phrases", "Trigger phrases", "Trigger pattern",
    "Häufige DE KI-Wörter", "Häufige DE KI-Phrasen", "Trigger-Wörter", "Trigger-Phrasen", "Trigger-Muster", "Zu beobachtende Phrasen", "Zu beobachtende Wörter", "Anzeichen",
)
# Fixed value: the quoted block under a label of an example.
BEFORE_BLOCK = r"\*\*(?:Before|Vorher)(?:\s*\([^)]*\))?:\*\*\s*\n>\s*(.+?)(?=\n\n|\n\*\*|\z)"


def pattern_files(spark: SparkSession, path: str) -> DataFrame:
    """Pattern case files ``pattern_*.json`` below ``path``."""
    return spark.read.schema(PATTERN_FILE).option("multiLine", True).option("pathGlobFilter", "pattern_*.json").json(path)


def end_to_end(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(END_TO_END).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def texts(spark: SparkSession, path: str, pattern: str = "*.{md,txt,json}") -> DataFrame:
    """``path, text`` of the files below ``path``; of a JSON object with ``input``, that field.

    Names that begin with ``_`` or ``.`` are left out; malformed JSON stays as it is.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), "value")
    field = F.when(F.col("path").endswith(".json"), F.get_json_object("value", "$.input"))
    return raw.select("path", F.coalesce(field, "value").alias("text"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """``path, domain, body`` of Markdown samples with an optional leading block."""
    raw = texts(spark, path, "*.{md,txt}")
    return raw.select("path", T.sample_domain(F.col("text")).alias("domain"), T.sample_body(F.col("text")).alias("body"))


def json_lines(spark: SparkSession, path: str, schema: str = PROBE) -> DataFrame:
    """Append-only JSON lines; lines that can't be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_before(revisions: DataFrame, key: str, when: str, text: str, cutoff: str | None = None) -> DataFrame:
    """``key, text``: each page's last revision, of those up to ``cutoff``; of equally late ones the greatest text."""
    rows = revisions if cutoff is None else revisions.filter(F.col(when) <= cutoff)
    return rows.groupBy(key).agg(F.max_by(text, F.struct(when, text)).alias(text))


def records(spark: SparkSession, path: str, languages: tuple[str, ...] = ("de", "ger", "deu")) -> DataFrame:
    """``id, text`` of harvested XML records in one of ``languages``: title and description."""
    schema = "header struct<identifier:string>, metadata struct<dc:struct<title:array<string>,description:array<string>,language:array<string>>>"
    raw = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", True).schema(schema).load(path)
    dc = F.col("metadata.dc")
    spoken = F.exists(dc["language"], lambda x: F.lower(F.trim(x)).isin(*languages))
    join = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    return raw.filter(spoken).select(F.col("header.identifier").alias("id"), F.trim(F.concat_ws(" ", join(dc["title"]), join(dc["description"]))).alias("text"))


def readmes(landed: DataFrame, content: str = "content") -> DataFrame:
    """``landed`` with ``text``: plain text of base64 Markdown."""
    return landed.withColumn("text", T.markdown_plain(T.decode_base64(F.col(content))))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct rows in an order that ``seed`` fixes."""
    return df.distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n)


def prose_corpus(df: DataFrame, key: str, text: str, domain: str, n: int, seed: int = 42, most: int = 400, least: int = 50) -> DataFrame:
    """The fetchers' pipeline: clean, trim to words, leave out what is too short, sample ``n`` of a domain."""
    clean = df.filter(F.col("domain") == domain).withColumn(text, T.trim_words(T.strip_wikitext(F.col(text)), most, least))
    return seeded_sample(clean.filter(F.col(text) != "").select(key, text), key, n, seed)


def rule_sections(packs: DataFrame, key: str = "pack", text: str = "text") -> DataFrame:
    """``key, rule_id, name, body``: sections of rule packs under ``### N. Name`` headings."""
    heads = packs.select(key, text, F.posexplode(F.split(F.concat(F.lit("\n"), text), java(r"\n(?=###\s+\d+\.\s)"))).alias("at", "part")).filter("at > 0")
    head = java(r"\A###\s+(\d+)\.\s+(.+)$", "m")
    return heads.select(
        key, F.regexp_extract("part", head, 1).cast("int").alias("rule_id"), T.strip(F.regexp_extract("part", head, 2)).alias("name"),
        F.regexp_replace("part", java(r"\A[^\n]*"), "").alias("body"),
    )


def next_heading(heads: DataFrame, key: str, start: str) -> DataFrame:
    """``heads`` with ``stop``: where the next heading of the same pack starts."""
    return heads.withColumn("stop", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def before_inputs(body: F.Column) -> F.Column:
    """Texts of the quoted blocks under a Before or Vorher label, on one line each."""
    raw = T.all_matches(body, java(BEFORE_BLOCK, "s"), 1)
    return F.transform(raw, lambda x: T.strip(F.regexp_replace(F.regexp_replace(x, r"\n>\s?", " "), java(r"\s+"), " ")))


def trigger_terms(body: F.Column) -> F.Column:
    """Terms of the labelled lists of a rule, in order of the labels."""
    lists = []
    for label in TRIGGER_LABELS:
        line = F.regexp_extract(body, rf"\*\*\Q{label}\E:\*\*\s*([^\n]+)", 1)
        lists.append(F.transform(F.split(line, r"[,;|]"), lambda t: F.regexp_replace(t, r"^[ .—]+|[ .—]+$", "")))
    return F.filter(F.concat(*lists), lambda t: (t != "") & ~t.startswith("`"))
