"""Scoring of texts as they arrive; stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexisift.operators import scan

DOCUMENT = "doc_id long, text string, lang string"


def scored_stream(spark: SparkSession, path: str, schema: str = DOCUMENT, lang: str = "en", files_per_batch: int = 100) -> DataFrame:
    """Scores of the parquet files that land in ``path``."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return scan.score(raw, "text", lang).drop("text", "hits")


def run(scored: DataFrame, out: str, checkpoint: str, keys: list[str], once: bool = True) -> StreamingQuery:
    """Append scores to ``out``; a batch that is run again after a failure leaves its rows once.

    Each batch writes its own folder, which a repeated batch overwrites.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = scored.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
