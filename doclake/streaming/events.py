"""Windowed counts with late data, and an idempotent fold of an event log per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.session import drop_path

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts by type and window; rows later than the watermark are dropped, repeats of an id within it count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event_type", "n")


def fold_state(events: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Last event per user, kept as numbered snapshots: a batch that runs again writes the same snapshot."""

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select("user_id", F.struct("ts", "event_id", "event_type").alias("e"))
        if epoch:
            new = new.unionByName(spark.read.parquet(f"{state}/{epoch - 1}"))
        new.groupBy("user_id").agg(F.max("e").alias("e")).write.mode("overwrite").parquet(f"{state}/{epoch}")
        if epoch > 1:
            drop_path(spark, f"{state}/{epoch - 2}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
