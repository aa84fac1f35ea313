"""Additions of this engine: file arrivals and retention as streams over the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunks import chunk_documents


def chunk_stream(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str):
    """Chunk document files as they arrive below a folder; each batch is appended once, by its number."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_documents(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    arrivals = spark.readStream.schema(schema).parquet(folder)
    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows; later ones than the watermark are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
