"""Streaming ingest: unwrap, validate, stamp, drop repeated deliveries, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pathloom.functions.urls import collect_origin
from pathloom.sources.events import unwrap, valid


def event_time(timestamp_ms: Column) -> Column:
    return F.timestamp_millis(timestamp_ms)


def accept(lines: DataFrame, origin: Column, received_at: Column) -> DataFrame:
    """Events of delivered batches, stamped with site and server time."""
    events = unwrap(lines.withColumns({"__origin": collect_origin(origin), "received_at": received_at}))
    return events.withColumn("origin", F.col("__origin")).drop("__origin")


def once(events: DataFrame, delay: str = "1 day", time: str = "event_time") -> DataFrame:
    """Every event id once, as long as its repeats arrive within ``delay``; events without id all stay."""
    # an event without id gets one of its own, so that one pass over the stream serves both kinds; Spark fixes the generator's
    # seed per micro-batch and partition, so a repeated task gives the same ids again
    known = F.coalesce(F.col("event_id").cast("string"), F.concat(F.lit("none-"), F.uuid()))
    timed = events.withWatermark(time, delay).withColumn("__id", known)
    return timed.dropDuplicatesWithinWatermark(["__id"]).drop("__id")


def once_batch(events: DataFrame) -> DataFrame:
    """The same on a table."""
    named = events.where(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    return named.unionByName(events.where(F.col("event_id").isNull()))


def append(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append to a Parquet table, partitioned so that later reads of one site or day skip the rest."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if by:
        writer = writer.partitionBy(*by)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def tail(events: DataFrame, since: Column) -> DataFrame:
    """Events received after ``since``: the batch form of a checkpointed stream."""
    return valid(events).where(F.col("received_at") > since)


def follow(
    spark: SparkSession, source: str, schema: T.StructType, path: str, checkpoint: str, since: Column | None = None, files_per_batch: int = 1_000,
) -> StreamingQuery:
    """Append what has arrived below ``source`` since the last run, in batches of bounded size.

    The checkpoint remembers the files that were read, so a run that was stopped goes on where it was. Each batch writes its own
    folder, so a repeated batch replaces itself. ``since`` bounds the first run as in ``tail``.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = valid(batch) if since is None else tail(batch, since)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
