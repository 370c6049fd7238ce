"""Activity figures on a stream, and centroids that follow new sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.clusters import assign_nearest, ema_centroids
from pathloom.streaming.late import read_mark


def follow_activity(
    events: DataFrame, path: str, checkpoint: str, time: str = "event_time", delay_ms: int = 600_000, length_ms: int = 3_600_000, every_ms: int = 300_000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Events and sessions per sliding window, exactly; a window is written to ``path/activity`` by the batch that closes it.

    A batch stores its events counted per session and step of ``every_ms`` (``path/buckets``) and the mark for the next one, the largest time
    so far less ``delay_ms``. A window is closed once the mark reaches its end, and late events count for the windows still open. A session
    counts for the windows that begin after its last step before this one, so nothing is held or sorted once per window. ``length_ms`` is a
    multiple of ``every_ms``; each batch writes its own folders, so a repeated batch replaces itself.
    """
    steps = length_ms // every_ms

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_mark(spark, path, number)
        at = F.unix_millis(time)
        rows = batch.where(F.col(time).isNotNull()).groupBy("session_id", F.floor(at / every_ms).alias("step"))
        counted = rows.agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("newest")).withColumn("day", F.floor(F.col("step") * every_ms / 86_400_000))
        counted.write.mode("overwrite").partitionBy("day").parquet(f"{path}/buckets/batch={number}")
        stored = spark.read.schema(T.StructType([*counted.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/buckets")
        newest = stored.where(F.col("batch") == number).agg((F.max("newest") - delay_ms).alias("mark"))
        newest.select(F.greatest("mark", F.lit(old).cast("long")).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number + 1}")
        new = read_mark(spark, path, number + 1)
        if new is None:
            stored = stored.where(F.lit(False))
        else:
            end = new // every_ms  # steps before it are over
            stored = stored.where((F.col("step") < end) & (F.col("day") <= end * every_ms // 86_400_000))
        if old is not None:
            begin = old // every_ms - steps + 1  # the first window that is still open
            stored = stored.where((F.col("step") >= begin) & (F.col("day") >= begin * every_ms // 86_400_000))
        per = stored.groupBy("session_id", "step").agg(F.sum("n").alias("n"))
        before = F.lag("step").over(Window.partitionBy("session_id").orderBy("step"))
        per = per.withColumn("gap", F.least(F.coalesce(F.col("step") - before, F.lit(steps)), F.lit(steps)))
        few = per.groupBy("step", "gap").agg(F.sum("n").alias("n"), F.count("session_id").alias("s"))
        each = few.withColumn("w", F.explode(F.sequence(F.col("step") - steps + 1, F.col("step"))))
        if new is not None:
            each = each.where(F.col("w") <= end - steps)
        if old is not None:
            each = each.where(F.col("w") >= begin)
        first = F.when(F.col("w") > F.col("step") - F.col("gap"), F.col("s")).otherwise(0)
        out = each.groupBy("w").agg(F.sum("n").alias("events"), F.sum(first).alias("sessions"))
        start = F.col("w") * every_ms
        out.select(
            F.timestamp_millis(start).alias("window_start"), F.timestamp_millis(start + length_ms).alias("window_end"), "events", "sessions"
        ).write.mode("overwrite").parquet(f"{path}/activity/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**(trigger or {"availableNow": True})).start()


def tumbling_motion(moves: DataFrame, keys: Sequence[str], time: str = "event_time", delay: str = "10 seconds", length: str = "2 seconds") -> DataFrame:
    """Pointer distance and flips per window, from rows that carry distance_px and jitter_count."""
    return moves.withWatermark(time, delay).groupBy(*keys, F.window(time, length).alias("w")).agg(
        F.sum("distance_px").alias("distance_px"), F.sum("jitter_count").alias("jitter_count")
    ).select(*keys, F.col("w.start").alias("window_start"), "distance_px", "jitter_count")


def follow_centroids(vectors: DataFrame, path: str, checkpoint: str, alpha: float = 0.3, trigger: dict | None = None) -> StreamingQuery:
    """Move the centroids with every batch of new vectors.

    Version n lies in ``path/version=n``; batch b reads version b and writes b+1, so a repeated batch
    gives the same result. Version 0 must exist.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_version(spark, path, number)
        new = ema_centroids(old, assign_nearest(batch, old), alpha)
        new.write.mode("overwrite").parquet(f"{path}/version={number + 1}")

    return (
        vectors.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={number}").select("cluster", "centroid")
