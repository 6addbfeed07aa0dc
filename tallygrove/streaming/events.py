"""Event-time aggregation and incremental ingestion, batch and streaming alike.

Windowed functions take a static or a streaming frame; on a stream they need the
watermark that `with_lateness` sets. The sinks are foreachBatch upserts on the
keys of the fact and KPI tables, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallygrove.sources.ingest import FACT_KEY, keep_first


def with_lateness(df: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    return df.withWatermark(ts, delay)


def tumbling(df: DataFrame, width: str = "1 day", keys=("event_type",), ts: str = "ts") -> DataFrame:
    """Per window and key: number of events, sum and mean of value."""
    w = df.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "n", "total", "mean")


def sliding(df: DataFrame, width: str = "1 day", slide: str = "6 hours", keys=("event_type",), ts: str = "ts") -> DataFrame:
    w = df.groupBy(F.window(ts, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, gap: str = "30 minutes", keys=("user_id",), ts: str = "ts") -> DataFrame:
    """Per key: runs of events with less than `gap` between neighbours."""
    s = df.groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select(*keys, F.col("session_window.start").alias("session_start"), "n", "total")


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(stream: DataFrame, keys=("event_id",), ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark; state goes when the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def append_facts(stream: DataFrame, table: str, checkpoint: str, key=FACT_KEY) -> StreamingQuery:
    """Runs what is there: each batch appends the first row of every key that the table lacks."""

    def write(batch: DataFrame, _id: int) -> None:
        fresh = keep_first(batch.withColumn("_row", F.monotonically_increasing_id()), key).drop("_row")
        session = batch.sparkSession
        if session.catalog.tableExists(table):
            fresh = fresh.join(session.table(table).select(*key), list(key), "left_anti")
        fresh.write.mode("append").saveAsTable(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_entities(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities whose digest differs from the stored one, or that have none."""
    old = stored.select("entity", F.col("digest").alias("__d"))
    return fresh.join(old, "entity", "left").where(~F.col("digest").eqNullSafe(F.col("__d"))).select("entity")


def running_counts(df: DataFrame, keys=("user_id",), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each event with its number within its key, in time order (batch only)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie)))
