"""A crawl that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.functions.text import html_to_text


def resume(spark: SparkSession, pages: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Pages that have arrived in the folder since the last call become (page_id, url, text) in `out`; the checkpoint
    remembers which were done. Texts of up to 100 characters are left for another try."""
    source = spark.readStream.schema(schema).parquet(pages)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("page_id", "url", html_to_text("html").alias("text")).where(F.length("text") > 100)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same batch again replaces itself

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
