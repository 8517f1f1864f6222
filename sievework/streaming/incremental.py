"""Structured Streaming runs of the stateless operators and a windowed count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def stream_table(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def masked(docs: DataFrame, text_col: str) -> DataFrame:
    """The same column functions as in batch."""
    return docs.withColumn(text_col, tx.squeeze(tx.mask_pii(F.col(text_col))))


def windowed_counts(events: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows per key and time window, closed once the watermark has passed."""
    w = F.window(at, width)
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start_at"), key, "n")
