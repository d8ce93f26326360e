"""Calls to functions outside the engine, and the gates around them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.lexicon import java


def fill(template: str, fields: dict[str, Column]) -> Column:
    """``template`` with ``{name}`` replaced by columns."""
    c = F.lit(template)
    for name, value in fields.items():
        c = F.replace(c, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return c


def within(call: Callable[[str], str], prompt: str, seconds: float | None) -> str:
    """``call(prompt)``, or a ``TimeoutError`` after ``seconds``; a call that hangs is left behind in a thread that ends with its process."""
    if seconds is None:
        return call(prompt)
    found: dict[str, object] = {}

    def run() -> None:
        try:
            found["value"] = call(prompt)
        except BaseException as x:
            found["error"] = x

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError(f"no answer in {seconds} seconds")
    if "error" in found:
        raise found["error"]
    return found["value"]


def respond(df: DataFrame, key: str, prompt: str, call: Callable[[str], str], attempts: int = 3, delay: float = 2.0, timeout: float | None = 300.0) -> DataFrame:
    """``key, raw, status, error`` of ``call`` for each prompt; a call without an answer after ``timeout`` seconds has failed.

    A failing call is tried again with doubled delays; a row that still fails has status ``failed``
    and the error, and stops no other row. A null prompt is ``skipped``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(1).to_pylist():
                raw, status, error = None, "skipped", None
                for n in range(attempts if p is not None else 0):
                    try:
                        raw, status, error = within(call, p, timeout), "ok", None
                        break
                    except Exception as x:
                        status, error = "failed", str(x)
                        if n + 1 < attempts:
                            time.sleep(delay * 2**n)
                out.append((raw, status, error))
            columns = [pa.array([o[i] for o in out], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["key", "raw", "status", "error"])

    rows = df.select(F.col(key).alias("key"), F.col(prompt).cast("string").alias("prompt"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, raw string, status string, error string").withColumnRenamed("key", key)


def checked_scores(scores: DataFrame, columns: list[str], low: int = 1, high: int = 10) -> DataFrame:
    """``scores`` with ``valid``: whether all of ``columns`` are given and between ``low`` and ``high``."""
    return scores.withColumn("valid", F.coalesce(F.forall(F.array(*columns), lambda x: x.between(low, high)), F.lit(False)))


def is_quota_error(error: Column) -> Column:
    return F.coalesce(F.contains(F.lower(error), F.lit("session limit")), F.lit(False))


def gate(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """One row ``planned, done, missing, complete``."""
    d = done.select(*keys).distinct().withColumn("_d", F.lit(1))
    counts = plan.select(*keys).distinct().join(d, keys, "left").agg(F.count(F.lit(1)).alias("planned"), F.count("_d").alias("done"))
    return counts.withColumn("missing", F.col("planned") - F.col("done")).withColumn("complete", F.col("missing") == 0)


def planned_documents(registry: DataFrame) -> DataFrame:
    """``license_class, sources, documents`` of a source registry (``name, n, subdir, license_class``), with a total row."""
    return registry.rollup("license_class").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("documents"))


def register_sql(spark: SparkSession) -> None:
    """For SQL: ``ngrams(text, n)`` as a table function, row by row in Python, and ``ngram_array(text, n)`` as an expression, which is the fast one."""
    bare = f"regexp_replace(t, r'{java(r'^[^\w]+|[^\w]+$')}', '')"
    tokens = f"filter(transform(regexp_extract_all(lower(text), r'{java(r'\S+')}', 0), t -> {bare}), t -> length(t) > 1 AND NOT t RLIKE r'{java(r'^\d+$')}')"
    grams = f"transform(filter(sequence(1, size({tokens})), i -> i <= size({tokens}) - n + 1), i -> array_join(slice({tokens}, i, n), ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ngram_array(text STRING, n INT) RETURNS ARRAY<STRING> RETURN CASE WHEN size({tokens}) >= n THEN {grams} ELSE array() END")

    from pyspark.sql.functions import udtf

    @udtf(returnType="ngram string")
    class Ngrams:
        def eval(self, text: str, n: int):
            import re

            tokens = [x for x in (re.sub(r"^[^\w]+|[^\w]+$", "", t) for t in (text or "").lower().split()) if len(x) > 1 and not x.isdigit()]
            for i in range(len(tokens) - n + 1):
                yield (" ".join(tokens[i : i + n]),)

    spark.udtf.register("ngrams", Ngrams)
