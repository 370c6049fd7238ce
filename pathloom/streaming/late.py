"""Late rows: kept in a table of their own, and merged into the sessions that were stored without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.behaviour import PASSIVE
from pathloom.operators.ordered import Keyed, lag, ordered, running_max, running_sum
from pathloom.operators.sessions import TTL_MS


def split(stream: DataFrame, path: str, checkpoint: str, delay_ms: int = 600_000, time: str = "timestamp", trigger: dict | None = None) -> StreamingQuery:
    """Store every row below ``path``, marked late if its time is not after the mark: the largest time before its batch less ``delay_ms``.

    Each batch writes its own folder and the mark for the next one, so a repeated batch replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = read_mark(spark, path, number)
        late = F.lit(False) if mark is None else F.coalesce(F.col(time) <= mark, F.lit(False))
        rows = f"{path}/rows/batch={number}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(rows)
        latest = spark.read.schema(batch.schema).parquet(rows).agg((F.max(time) - delay_ms).alias("mark"))
        latest.select(F.greatest("mark", F.lit(mark).cast("long")).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number + 1}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**(trigger or {"availableNow": True})).start()


def read_mark(spark: SparkSession, path: str, number: int) -> int | None:
    """The mark that batch ``number`` starts with, or None."""
    return spark.read.schema("mark long").parquet(f"{path}/marks/batch={number}").first()[0] if number else None


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``late`` and ``batch``."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.withColumn("late", F.col("late").cast("boolean"))


def as_sessions(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Every event as a session of its own: what ``merge`` puts together."""
    kind = F.col("event_type")
    return events.select(
        user, F.lit(1).cast("long").alias("events"), F.col("timestamp").alias("started"), F.col("timestamp").alias("ended"),
        F.struct("timestamp", "event_id", "utm_source").alias("first"), F.struct("timestamp", "event_id", "pathname").alias("last"),
        (kind == "navigation").cast("long").alias("page_depth"), (~kind.isin(PASSIVE)).cast("long").alias("interactions"),
    )


def merge(parts: DataFrame, user: str = "user_id", ttl_ms: int = TTL_MS, bounded: bool = False) -> DataFrame:
    """Sessions from parts of sessions: parts less than ``ttl_ms`` apart, or overlapping, become one.

    First and last values go by event time, so the order in which parts became known does not matter.
    """

    def build(k: Keyed) -> DataFrame:
        k = k.add(__reach=running_max(F.col("ended")))
        k = k.add(__before=lag(F.col("__reach")))
        opens = F.col("__before").isNull() | (F.col("started") - F.col("__before") >= ttl_ms)
        return k.add(__no=running_sum(opens.cast("long"))).df

    numbered = ordered(parts.withColumn("__id", F.col("first.event_id")), [user], ["started", "__id"], build, bounded)
    return numbered.groupBy(user, "__no").agg(
        F.sum("events").alias("events"), F.min("started").alias("started"), F.max("ended").alias("ended"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.sum("page_depth").alias("page_depth"), F.sum("interactions").alias("interactions"),
    ).drop("__no")


def correct(sessions: DataFrame, late: DataFrame, user: str = "user_id", ttl_ms: int = TTL_MS, bounded: bool = False) -> DataFrame:
    """Stored sessions with late events merged in: they may begin earlier, end later, join two sessions or be new.

    Only sessions of users with late events are sorted again.
    """
    who = late.select(user).distinct()
    touched = sessions.join(who, user, "left_semi").unionByName(as_sessions(late, user))
    return merge(touched, user, ttl_ms, bounded).unionByName(sessions.join(who, user, "left_anti"))
