"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisift.llm import bpe, leaks, lookalike, pairs, quality, subjects, terms, wrapper
from lexisift.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return wrapper.outside_lines(table(spark, d, "fetch_de_human_corpus"), "id", "source_url", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flagged(table(spark, d, "ai_career_01"), "id", "input", "reference_rewrite")


def _looking(spark: SparkSession, d: str) -> DataFrame:
    """``tbl, id, text`` of all cases and pages."""
    cases = table(spark, d, "pattern_019").select(F.explode("cases").alias("c")).select(F.lit("pattern_019").alias("tbl"), F.col("c.id").alias("id"), F.col("c.input").alias("text"))
    pages = table(spark, d, "fetch_de_human_corpus").select(F.lit("fetch_de_human_corpus").alias("tbl"), "id", "text")
    return cases.unionByName(pages)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(_looking(spark, d), "tbl", "id", "text").withColumnRenamed("group", "tbl")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_classes(_looking(spark, d), "tbl", "id", "text").withColumnRenamed("group", "tbl")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look(_looking(spark, d), "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    marked = terms.marked_terms(table(spark, d, "mine_patterns"), "ngram", "run_id", ["ai_count", "human_count"])
    return marked.filter("mark is not null").select(F.col("term").alias("ngram"), "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_counts(table(spark, d, "mine_patterns"), "ngram", "run_id", ["ai_count", "human_count"])


def bodies(spark: SparkSession, d: str, by: Callable[[str], tuple], names: list[str]) -> DataFrame:
    """``key`` (table and id), ``lang`` and figures of the main bodies of the two fetched tables; encyclopedia texts are all body."""
    pages, wiki = table(spark, d, "fetch_de_human_corpus"), table(spark, d, "fetch_de_wikipedia_ai_tagged")
    columns = [T.StructField("key", T.StringType()), T.StructField("lang", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names)]

    def row(key: str, lines: list[str], outside: list[int]) -> tuple:
        left = set(outside)
        body = "\n".join(x for i, x in enumerate(lines) if i not in left)
        return (key, *by(body)) if body.strip() else (key, None, *[None] * len(names))

    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in columns)
    own = wrapper.map_pages(pages, "id", "source_url", "text", row, schema, [pa.string(), *[pa.float64()] * len(names)]).filter(F.col(names[0]).isNotNull())
    other = quality.measured(wiki.select("id", "text").filter("id is not null").distinct(), "id", "text", by, names)
    named = lambda df, tbl: df.withColumn("key", F.to_json(F.struct(F.lit(tbl).alias("tbl"), F.col("key").alias("id"))))
    return named(own, "fetch_de_human_corpus").unionByName(named(other, "fetch_de_wikipedia_ai_tagged"))


def _unkey(df: DataFrame) -> DataFrame:
    key = F.from_json("key", "tbl string, id string")
    return df.select(key["tbl"].alias("tbl"), key["id"].alias("id"), *(c for c in df.columns if c != "key"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _unkey(quality.decided(bodies(spark, d, quality.inspect, list(quality.LOOKS))))


def p5_stats(spark: SparkSession, d: str) -> DataFrame:
    return _unkey(quality.ranked(bodies(spark, d, quality.measure, list(quality.STATISTICS)).distinct()))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    examples, items = table(spark, d, "subject_examples"), table(spark, d, "eval_items")
    return subjects.subjects_of(table(spark, d, "documents"), "doc_id", "text", examples, "subject", "text", items)


TERMS_SQL = """
SELECT nfc_normalize(lower(trim(ngram))) AS term, CAST(sum(coalesce(ai_count, 0) + coalesce(human_count, 0)) AS BIGINT) AS occurrences,
       CAST(count(DISTINCT run_id) AS BIGINT) AS records
FROM (SELECT DISTINCT * FROM mine_patterns WHERE ngram IS NOT NULL) GROUP BY 1"""

QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_classes": p3_classes, "p3_forms": p3_forms, "p4_found": p4_found, "p4_terms": p4_terms, "p5_found": p5_found, "p5_stats": p5_stats, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}

SQL: dict[str, str] = {
    "p4_terms": TERMS_SQL,
    "p4_found": f"""
WITH t AS ({TERMS_SQL}), m AS (
  SELECT term AS ngram, CASE WHEN occurrences < 5 THEN 'rare' WHEN records * 2 > (SELECT count(DISTINCT run_id) FROM mine_patterns) THEN 'common' END AS mark FROM t)
SELECT ngram, mark FROM m WHERE mark IS NOT NULL""",
}
