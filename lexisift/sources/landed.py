"""Corpora from landed web material: a registry of sources, parsers of landed JSON and one sampling pipeline.

Fetching itself is left to other tools; what they land (JSON answers, HTML, wiki markup) is read here.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.functions import text as T
from lexisift.sources.corpus import samples

# The sources by name, documents wanted, folder, licence class, kind of material, licence, most and least words.
SOURCES = """
wikipedia_academic 8 wikipedia_academic redistributable wikitext CC-BY-SA-3.0 800 200
ssoar_academic 5 ssoar_academic redistributable plain per-record 800 200
bgbl_legal 5 bgbl_legal redistributable html PD-§5-UrhG 800 200
rechtsprechung_legal 3 rechtsprechung_legal redistributable html PD-§5-UrhG 800 200
bundestag_legal 3 bundestag_legal redistributable plain PD-§5-UrhG 800 200
ubuntuusers_technical 8 ubuntuusers_technical redistributable wikitext CC-BY-SA-3.0 800 200
linuxwiki_technical 5 linuxwiki_technical redistributable wikitext GFDL 800 200
wikipedia_technical 6 wikipedia_technical redistributable wikitext CC-BY-SA-3.0 800 200
github_oss_technical 6 github_oss_technical redistributable markdown per-repo 800 200
wikipedia_marketing 8 wikipedia_marketing redistributable wikitext CC-BY-SA-3.0 800 200
wikipedia_career 8 wikipedia_career redistributable wikitext CC-BY-SA-3.0 800 200
bundesregierung_career 5 bundesregierung_career redistributable html PD-§5-UrhG 800 200
stackexchange_career 5 stackexchange_career redistributable bio CC-BY-SA-4.0 800 200
github_profile_career 6 github_profile_career redistributable markdown per-repo 800 200
apple_marketing 4 apple_marketing research_only html copyright 250 50
samsung_marketing 3 samsung_marketing research_only html copyright 250 50
microsoft_marketing 3 microsoft_marketing research_only html copyright 250 50
startnext_marketing 3 startnext_marketing research_only html copyright 250 50
reddit_de_casual 5 reddit_casual research_only post copyright 200 30
travel_blogs_casual 3 travel_blogs_casual research_only html copyright 250 50
lifestyle_blogs_casual 3 lifestyle_blogs_casual research_only html copyright 250 50
karrierebibel_career 3 karrierebibel_career research_only html copyright 250 50
bewerbung_career 3 bewerbung_career research_only html copyright 250 50
heise_technical 4 heise_technical research_only html copyright 250 50
"""
#: Kinds whose text must be German.
GERMAN_ONLY = ("bio", "post", "markdown")


def registry(spark: SparkSession, license_class: str | None = None) -> DataFrame:
    """``name, n, subdir, license_class, kind, license, most, least, domain`` of the sources, or of one licence class."""
    rows = []
    for line in SOURCES.strip().splitlines():
        name, n, folder, cls, kind, licence, most, least = line.split()
        rows.append((name, int(n), folder, cls, kind, licence, int(most), int(least), name.rsplit("_", 1)[1]))
    df = spark.createDataFrame(rows, "name string, n int, subdir string, license_class string, kind string, license string, most int, least int, domain string")
    return df if license_class is None else df.filter(F.col("license_class") == license_class)


def plain(raw: Column, kind: Column) -> Column:
    """Plain text of landed material by its kind: wikitext, html, markdown, bio (HTML on one line), post or plain."""
    line = T.strip(F.regexp_replace(T.html_text(raw), T.SPACES, " "))
    return F.when(kind == "wikitext", T.strip_wikitext(raw)).when(kind == "html", T.html_paragraphs(raw, most=1 << 30)).when(kind == "markdown", T.markdown_plain(raw)).when(kind == "bio", line).otherwise(raw)


def trimmed(c: Column, most: Column, least: Column) -> Column:
    """The first ``most`` pieces joined by one blank, or empty if there are fewer than ``least``."""
    w = T.spaced_words(c)
    return F.when(F.size(w) < least, "").otherwise(F.array_join(F.slice(w, F.lit(1), most), " "))


def seeded_rank(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def collected(landed: DataFrame, sources: DataFrame, fetch_date: str, seed: int = 42, oversample: bool = False) -> DataFrame:
    """Documents of ``landed`` (``name, title, source_url, raw`` and, where it differs from the source's, ``license``) by their sources' rules: at most ``n`` of each source, in an order that ``seed`` fixes.

    Titles are taken once a source. With ``oversample`` only the first ``max(3 n, n + 20)`` titles are tried, as a fetcher
    that pays for each page would. Texts that are too short, null or, where the kind asks for it, not German
    are left out. Each source is numbered by itself; the number of rows kept is bounded by the registry.
    """
    from pyspark.sql import Window

    own = F.col("license") if "license" in landed.columns else F.lit(None).cast("string")
    rows = landed.select("name", "title", F.struct("source_url", "raw", own.alias("license")).alias("p")).groupBy("name", "title").agg(F.min("p").alias("p")).join(F.broadcast(sources), "name")
    order = Window.partitionBy("name").orderBy(seeded_rank(seed, "title"), "title")
    if oversample:
        rows = rows.withColumn("tried", F.row_number().over(order)).filter(F.col("tried") <= F.greatest(3 * F.col("n"), F.col("n") + 20))
    rows = rows.withColumn("text", trimmed(plain(F.col("p.raw"), F.col("kind")), F.col("most"), F.col("least"))).filter(F.col("text") != "")
    rows = rows.filter(~F.col("kind").isin(*GERMAN_ONLY) | T.looks_german(F.col("text")))
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("n"))
    return rows.select(
        T.slug(F.col("name"), F.col("title")).alias("id"), "text", F.col("p.source_url").alias("source_url"), F.coalesce("p.license", "license").alias("license"), F.lit(fetch_date).alias("fetch_date"), "license_class",
        F.create_map(F.lit("domain"), F.col("domain"), F.lit("source"), F.col("name"), F.lit("title"), F.col("title")).alias("metadata"), F.col("subdir").alias("source"),
    )


def wiki_titles(answers: DataFrame, raw: str, what: str = "categorymembers") -> DataFrame:
    """``title`` of the pages that landed list answers name (``categorymembers`` or ``embeddedin``), sorted, each once; all pages of a continued list together."""
    names = F.from_json(F.get_json_object(raw, f"$.query.{what}"), "array<struct<title:string>>")
    return answers.select(F.explode(names).alias("m")).select("m.title").filter("title is not null").distinct().orderBy("title")


def wiki_revisions(answers: DataFrame, raw: str) -> DataFrame:
    """``title, timestamp, text`` of the revisions in landed page answers; markup under either of its two names."""
    kind = "map<string, struct<title:string, revisions:array<struct<timestamp:string, content:string, `*`:string>>>>"
    pages = F.map_values(F.from_json(F.get_json_object(raw, "$.query.pages"), kind))
    rows = answers.select(F.explode(pages).alias("p")).select("p.title", F.explode("p.revisions").alias("r"))
    return rows.select("title", "r.timestamp", F.coalesce(F.col("r")["*"], F.col("r.content")).alias("text"))


def wiki_url(title: Column, site: str) -> Column:
    """Address of a wiki page."""
    return F.concat(F.lit(f"{site.rstrip('/')}/wiki/"), T.url_quote(title))


def parliament(answers: DataFrame, raw: str, fallback: str) -> DataFrame:
    """``title, source_url, raw`` of a parliament's landed documents, whose fields have one of two names."""
    item = "array<struct<titel:string, title:string, text:string, inhalt:string, fundstelle:struct<pdf_url:string>, downloadUrl:string>>"
    items = F.from_json(F.coalesce(F.get_json_object(raw, "$.documents"), F.get_json_object(raw, "$.items")), item)
    rows = answers.select(F.explode(items).alias("d"))
    title, body = F.coalesce("d.titel", "d.title", F.lit("")), F.coalesce("d.text", "d.inhalt", F.lit(""))
    url = F.coalesce(F.nullif(F.col("d.fundstelle.pdf_url"), F.lit("")), F.col("d.downloadUrl"), F.lit(fallback))
    return rows.select(title.alias("title"), url.alias("source_url"), T.strip(F.when(title != "", F.concat(title, F.lit("\n\n"), body)).otherwise(body)).alias("raw"))


def profiles(answers: DataFrame, raw: str, site: str) -> DataFrame:
    """``title, source_url, raw``: the users' descriptions in landed answers; users without one are left out."""
    items = F.from_json(F.get_json_object(raw, "$.items"), "array<struct<user_id:string, display_name:string, link:string, about_me:string>>")
    rows = answers.select(F.explode(items).alias("u")).filter("u.about_me <> ''")
    return rows.select(F.coalesce("u.user_id", F.lit("unknown")).alias("title"), F.coalesce("u.link", F.concat(F.lit(f"{site}/users/"), F.col("u.user_id"))).alias("source_url"), F.col("u.about_me").alias("raw"))


def posts(answers: DataFrame, raw: str) -> DataFrame:
    """``title, source_url, raw`` of landed posts: the title and, behind a full stop, the text."""
    items = F.from_json(F.get_json_object(raw, "$.data.children"), "array<struct<data:struct<id:string, title:string, selftext:string, url:string>>>")
    p = F.col("p.data")
    rows = answers.select(F.explode(items).alias("p"))
    title = F.coalesce(p["title"], F.lit(""))
    return rows.select(F.coalesce(p["id"], F.lit("unknown")).alias("title"), p["url"].alias("source_url"), F.when(F.coalesce(p["selftext"], F.lit("")) != "", T.strip(F.concat(title, F.lit(". "), p["selftext"]))).otherwise(title).alias("raw"))


def readme(answers: DataFrame, raw: str) -> DataFrame:
    """``text`` of landed file answers, decoded if they are in base64; an answer without content is left out."""
    content, encoding = F.get_json_object(raw, "$.content"), F.get_json_object(raw, "$.encoding")
    return answers.withColumn("text", F.when(encoding == "base64", T.decode_base64(content)).otherwise(content)).filter("text <> ''")


def literal_inputs(spark: SparkSession, inputs: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """``id, text, lang, domain`` of texts given in code; without a language or domain, ``en`` and ``casual``."""
    rows = [(k, v.get("text"), v.get("lang", "en"), v.get("domain", "casual")) for k, v in inputs.items()]
    return spark.createDataFrame(rows, "id string, text string, lang string, domain string")


def single_text(spark: SparkSession, path: str = "-") -> DataFrame:
    """``path, text`` of one file, or of the standard input for ``-``."""
    if path == "-":
        return spark.createDataFrame([("-", sys.stdin.read())], "path string, text string")
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))


def personal_samples(spark: SparkSession, variable: str, home: str, folder: str = "writing-samples") -> DataFrame:
    """``samples`` of the first folder that exists: the one the environment names, one in the home folder, one here."""
    named = [Path(os.environ[variable]).expanduser()] if os.environ.get(variable) else []
    places = [*named, Path.home() / home, Path.cwd() / folder]
    for p in places:
        if p.is_dir():
            return samples(spark, str(p))
    raise FileNotFoundError("no folder of samples: set $" + variable + " or make one of " + ", ".join(map(str, places)))


def result_key(path: Column, base: str = "") -> Column:
    """Name of a file's result: its path below ``base`` with the separators as underscores, without its ending."""
    below = F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(below, r"^[/\\]+", ""), r"[/\\]", "_"), r"\.[A-Za-z0-9]+$", "")


def short_names(model: Column, names: Mapping[str, str]) -> Column:
    """Full name of a model for its short one; other names stay."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), model), model)


def listed(argument: str, known: tuple[str, ...]) -> list[str]:
    """Names of an argument parted by commas, ``all`` for each; an unknown name is an error."""
    names = list(known) if argument.strip() == "all" else [x.strip() for x in argument.split(",") if x.strip()]
    if unknown := [x for x in names if x not in known]:
        raise ValueError(f"unknown: {', '.join(unknown)}; known: {', '.join(known)}")
    return names
