"""Streaming forms of append-with-dedup (K2), upsert (K3), the chat log (K10) and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.sinks import upserted


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_links(stream: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """K2: rows whose keys didn't come within the delay; state is dropped as the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert_sink(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """K3: each batch is merged into a new version of the table; a replayed batch writes the same version again."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*[c for c in batch.columns if c != key])).alias("r")).select("r.*")
        merged = upserted(spark.read.schema(batch.schema).parquet(f"{path}/v={number - 1}"), last, key) if number else last
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chat_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """K10."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(stream: DataFrame, size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events by type in windows of time; late rows within the delay still count."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
