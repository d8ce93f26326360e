"""Writers of corpora, candidates, results and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.lexicon import DIMENSIONS, pack
from lexisift.operators import rewrite, scan

# Fixed value: what the licence file of material for research alone adds.
RESEARCH_NOTE = """License class: research_only
Fair-use research excerpt — eval use only.
No-redistribution clause: do not publish these excerpts.
Attribution required; source URL above.
"""


def markdown_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``content``: the text below its leading block."""
    head = T.frontmatter({k: F.col(k) for k in ("id", "source_url", "license", "license_class", "fetch_date")}, F.col("metadata"))
    return docs.withColumn("content", F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")))


def _exists(path: str) -> bool:
    """Whether ``path`` is there, by the file system that Spark itself writes to."""
    spark = SparkSession.getActiveSession()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _write_text(path: str, text: str) -> None:
    """Writes one small file by the file system that Spark itself writes to."""
    spark = SparkSession.getActiveSession()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_files(files: DataFrame, base: str) -> int:
    """Writes ``path, content`` of each row as a file below ``base``, in the tasks; gives the number of files.

    ``base`` is a folder that all executors reach (a URI, or an absolute path of a shared folder). A task that
    runs again writes the same files again, so lost executors do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa.fs.FileSystem.from_uri(base)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").filter("path is not null and content is not null").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def corpus_files(docs: DataFrame, source: str = "source") -> DataFrame:
    """``path, content``: a Markdown file a document below its licence class and source, and two files on each source's licence and origin."""
    folder = F.concat_ws("/", "license_class", F.col(source))
    texts = markdown_documents(docs).select(F.concat(folder, F.lit("/"), F.col("id"), F.lit(".md")).alias("path"), "content")
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("None")), F.lit("\n"))
    research = F.when(F.col("license_class") == "research_only", F.lit(RESEARCH_NOTE)).otherwise("")
    licence = F.concat(line("", "license"), line("Source: ", "source_url"), line("Fetched: ", "fetch_date"), research)
    origin = F.concat(line("source_name: ", source), line("license_class: ", "license_class"), line("license: ", "license"), line("fetch_date: ", "fetch_date"), line("doc_count: ", "doc_count"), line("url: ", "source_url"))
    pairs = F.array(F.struct(F.lit("_LICENSE").alias("name"), licence.alias("content")), F.struct(F.lit("_SOURCE").alias("name"), origin.alias("content")))
    beside = sidecars(docs, source).select(folder.alias("folder"), F.explode(pairs).alias("f")).select(F.concat("folder", F.lit("/"), F.col("f.name")).alias("path"), "f.content")
    return texts.unionByName(beside)


def write_corpus(docs: DataFrame, path: str, source: str = "source") -> None:
    """Documents by licence class and source, with a small table of each source's licence and size beside them; ``corpus_files`` has the form of a file a document."""
    markdown_documents(docs).write.mode("overwrite").partitionBy("license_class", source).parquet(f"{path}/documents")
    sidecars(docs, source).write.mode("overwrite").json(f"{path}/sources")


def sidecars(docs: DataFrame, source: str = "source") -> DataFrame:
    """``license_class, source, license, source_url, fetch_date, doc_count``: facts of the first document by id, and the count."""
    first = F.min(F.struct("id", "license", "source_url", "fetch_date"))
    out = docs.groupBy("license_class", source).agg(first.alias("f"), F.count(F.lit(1)).alias("doc_count"))
    return out.select("license_class", source, "f.license", "f.source_url", "f.fetch_date", "doc_count")


def write_candidates(ranked: DataFrame, path: str, kind: str = "tsv") -> None:
    """A ranked list as TSV with a header, or as JSON lines; small by its nature (top k)."""
    writer = ranked.orderBy("rank").coalesce(1).write.mode("overwrite")
    writer.csv(path, sep="\t", header=True) if kind == "tsv" else writer.json(path)


def append_results(results: DataFrame, path: str, keys: list[str]) -> None:
    """Append results whose keys are not there yet, so that a repeated run adds nothing."""
    spark = results.sparkSession
    once = results.dropDuplicates(keys)
    if _exists(path):
        once = once.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    once.write.mode("append").parquet(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def render(name: str, summary: Row | dict, patterns: list[Row] | None = None) -> str:
    """Markdown of a report: the summary's figures, then a rate for each pattern."""
    facts = summary.asDict() if isinstance(summary, Row) else summary
    lines = [f"# Report: {name}", "", "## Summary", "", *(f"- **{k}**: {v}" for k, v in facts.items())]
    if patterns:
        lines += ["", "## Per pattern", "", "| pattern | rate |", "|---|---|", *(f"| #{p['pattern_id']} | {p['rate']} |" for p in patterns)]
    return "\n".join(lines) + "\n"


def write_report(folder: str, name: str, summary: Row, patterns: list[Row] | None = None, now: datetime | None = None) -> tuple[Path, Path]:
    """The same report as JSON and Markdown under one timed name; takes collected rows of a bounded report."""
    stem = Path(folder) / f"{name}_{(now or datetime.now()):%Y%m%dT%H%M%S}"
    data = {"summary": summary.asDict(), "per_pattern": [p.asDict() for p in patterns or []]}
    a, b = stem.with_suffix(".json"), stem.with_suffix(".md")
    _write_text(f"{folder.rstrip('/')}/{a.name}", json.dumps(data, ensure_ascii=False, indent=2, default=str))
    _write_text(f"{folder.rstrip('/')}/{b.name}", render(name, summary, patterns))
    return a, b


# The labels and widths of the texts below.
RULE = "-" * 60


def _of(hits: str, keys: list[str]) -> Column:
    """The rules of ``keys`` that fire."""
    return F.map_filter(hits, lambda k, v: k.isin(keys) & (v > 0))


def _labelled(hits: Column, lang: str, sign: str) -> Column:
    """A line for each rule of a map of hits, most hits first, then by name."""
    labels = F.create_map(*(F.lit(x) for r in pack(lang) for x in (r.key, r.label)))
    order = F.array_sort(F.transform(F.map_entries(hits), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("rule"))))
    return F.transform(order, lambda e: F.format_string(f"    {sign[0]} %s: {sign[1:]}%d", F.coalesce(F.try_element_at(labels, e["rule"]), e["rule"]), -e["n"]))


def score_texts(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, report``: the score of each text in words: figures, rhythm, hits by dimension, paragraphs; made in the row."""
    scored = scan.score(df.select(key, F.coalesce(text, F.lit("")).alias("_text")), "_text", lang)
    rows = scored.join(scan.rhythm(df.select(key, F.coalesce(text, F.lit("")).alias("_text")), key, "_text"), key)
    clean = T.clean_text(F.col("_text"))
    blocks = []
    for d in DIMENSIONS:
        keys = [r.key for r in pack(lang) if r.dimension == d]
        own = _of("hits", keys)
        n = F.aggregate(F.map_values(own), F.lit(0).cast("long"), lambda a, v: a + v)
        head = F.format_string(f"%-14s  %3d hits  (%.2f/100w)", F.lit(d), n, T.density(n, F.col("words")))
        blocks.append(F.when(n > 0, F.concat(F.array(head), _labelled(own, lang, "-"))).otherwise(F.array().cast("array<string>")))

    def paragraph(p: Column, i: Column) -> Column:
        foreign = T.hebrew_share(p) > 0.4 if lang == "en" else None
        words, hits = T.word_count(p), scan.hits_map(p, lang, foreign)
        tells = scan.tier1(hits, words, lang)
        d = T.density(tells, words)
        mark = F.when(T.hebrew_share(p) > 0.4, "  [Hebrew]").otherwise("") if lang == "en" else F.lit("")
        return F.format_string("P%2d  %3dw  %2d hits  %5.1f/100w  -> %s%s", i + 1, words, tells, d, T.band(d), mark)

    head = F.array(
        F.lit("=" * 60), F.lit(f"DENSITY REPORT (lang={lang})"), F.lit("=" * 60), F.format_string("Words:           %d", "words"), F.format_string("Paragraphs:      %d", F.size(T.paragraphs(clean))),
        F.format_string("Tier-1 hits:     %d", "tier1"), F.format_string("Density / 100w:  %.2f", "density"), F.format_string("Verdict:         %s", "band"), F.lit(""),
        F.format_string("Rhythm:          mean %.1fw/sent, stdev %.1f, cv %.2f -> %s", "mean", "stdev", F.coalesce("cv", F.lit(0.0)), "verdict"), F.lit(""), F.lit(RULE), F.lit("BY DIMENSION"), F.lit(RULE),
    )
    parts = F.array(F.lit(""), F.lit(RULE), F.lit("PER PARAGRAPH"), F.lit(RULE))
    return rows.select(key, F.array_join(F.concat(head, *blocks, parts, F.transform(T.paragraphs(clean), paragraph)), "\n").alias("report"))


def compare_texts(df: DataFrame, key: str, before: str, after: str, lang: str = "en") -> DataFrame:
    """``key, report``: each rewrite against its text in words: lengths, tells, rules cleaned and introduced."""
    c = rewrite.compare(df.select(key, F.coalesce(before, F.lit("")).alias("_a"), F.coalesce(after, F.lit("")).alias("_b")), "_a", "_b", lang)
    some = lambda m, title, sign: F.when(F.size(m) > 0, F.concat(F.array(F.lit(title)), _labelled(F.col(m), lang, sign))).otherwise(F.array().cast("array<string>"))
    side = lambda name, s: F.format_string(f"{name:8s} %4dw   %3d tells   %.2f/100w", f"{s}_words", f"{s}_tier1", f"{s}_density")
    head = F.array(
        F.lit("=" * 60), F.lit(f"REWRITE: BEFORE AND AFTER (lang={lang})"), F.lit("=" * 60), side("Input:", "before"), side("Output:", "after"), F.lit(""),
        F.format_string("Length:  %+d words (%+.1f%%)  -> %s", F.col("after_words") - F.col("before_words"), "length_pct", "length_verdict"), F.format_string("Tells:   %+d removed", "tier1_removed"), F.lit(""),
    )
    none = F.when(F.size("introduced") == 0, F.array(F.lit("(No new tells.)"))).otherwise(F.array().cast("array<string>"))
    return c.select(key, F.array_join(F.concat(head, some("cleaned", "Cleaned:", "--"), some("introduced", "Introduced by the rewrite:", "+"), none), "\n").alias("report"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row over ``evals.audit``: patterns, cases, and cases by signal."""
    one = lambda s: F.sum(F.when(F.col("signal") == s, 1).otherwise(0)).cast("long")
    return audited.agg(F.countDistinct("pattern_id").alias("patterns"), F.count(F.lit(1)).alias("cases"), one("fires").alias("fires"), one("no_signal").alias("no_signal"), one("unmapped").alias("unmapped"))


def sample_audit(df: DataFrame, key: str, text: str, lang: str = "en") -> DataFrame:
    """``key, words, tier1, density, band, top``: each sample's score without its leading block, and its five rules with most hits if the band isn't low."""
    bare = df.select(key, T.strip_frontmatter(F.coalesce(text, F.lit(""))).alias("_text"))
    scored = scan.score(bare, "_text", lang)
    order = F.array_sort(F.transform(F.map_entries(F.map_filter("hits", lambda k, v: v > 0)), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("rule"))))
    top = F.array_join(F.transform(F.slice(order, 1, 5), lambda e: F.concat(e["rule"], F.lit(": "), -e["n"])), "; ")
    return scored.select(key, "words", "tier1", "density", "band", F.when(F.col("band") != "LOW", top).otherwise("").alias("top"))


def audit_text(summary: Row | dict, title: str, lines: list[str] | None = None) -> str:
    """An audit's summary in words, and the lines of what it found."""
    facts = summary.asDict() if isinstance(summary, Row) else summary
    return "\n".join(["=" * 60, title, "=" * 60, *(f"{k + ':':30s}{v}" for k, v in facts.items()), "", RULE, *(lines or [])])


def seeded_cases(sections: DataFrame, lang: str, most: int = 8) -> DataFrame:
    """A case file row for each rule section with examples: its inputs and its first ``most`` trigger terms."""
    from lexisift.sources.corpus import before_inputs, trigger_terms

    s = sections.withColumn("inputs", before_inputs(F.col("body"))).withColumn("terms", F.slice(trigger_terms(F.col("body")), 1, most)).filter(F.size("inputs") > 0)
    case = lambda x, i: F.struct(F.format_string("pattern_%03d_%s_%02d", F.col("rule_id"), F.lit(lang), i + 1).alias("id"), x.alias("input"), F.col("terms").alias("expected_changes"))
    return s.select(F.col("rule_id").alias("pattern_id"), F.col("name").alias("pattern_name"), F.lit(lang).alias("lang"), F.transform("inputs", case).alias("cases"))


def write_cases(cases: DataFrame, base: str) -> int:
    """Writes each row of ``seeded_cases`` as ``pattern_NNN.json`` below ``base``; gives the number of files."""
    files = cases.select(F.format_string("pattern_%03d.json", "pattern_id").alias("path"), F.concat(F.to_json(F.struct(*cases.columns), {"pretty": "true"}), F.lit("\n")).alias("content"))
    return write_files(files, base)
