"""Sessions on a stream, and behaviour derived when a session closes.

Session windows merge per task before the shuffle, so a user with very many events stays cheap. What
depends on the order of a session's events is derived by the batch operators, in ``foreachBatch``,
from the stored events of the sessions that have just closed: one definition serves both ways.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.behaviour import PASSIVE
from pathloom.operators.sessions import TTL_MS


def stream_sessions(events: DataFrame, user: str = "user_id", ttl_ms: int = TTL_MS, delay: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """Closed sessions with first touch, exit page, depth and bounce, emitted once the watermark passes their timeout.

    A session window merges events exactly one gap apart, but a session ends when idle for the timeout,
    hence one millisecond less. First and last values go by event time, so arrival order is irrelevant.
    """
    rank = F.struct(time, "event_id")
    kind = F.col("event_type")
    pages = F.count_if(kind == "navigation")
    out = _windows(events, user, ttl_ms, delay, time).agg(
        F.count(F.lit(1)).alias("events"),
        F.min(time).alias("started_at"),
        F.max(time).alias("ended_at"),
        F.min_by("utm_source", rank).alias("utm_source"),
        F.max_by("pathname", rank).alias("exit_page"),
        pages.alias("page_depth"),
        ((pages <= 1) & (F.count_if(~kind.isin(PASSIVE)) == 0)).alias("bounce_flag"),
    )
    return out.drop("w").withColumn("exit_reason", F.lit("timeout"))


def session_spans(events: DataFrame, user: str = "user_id", ttl_ms: int = TTL_MS, delay: str = "10 minutes", time: str = "event_time") -> DataFrame:
    """User, start and end of the sessions of ``stream_sessions``: all that ``on_close`` reads, with a state of two times per session."""
    out = _windows(events.select(user, time), user, ttl_ms, delay, time).agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"))
    return out.drop("w")


def _windows(events: DataFrame, user: str, ttl_ms: int, delay: str, time: str) -> GroupedData:
    return events.withWatermark(time, delay).groupBy(user, F.session_window(time, f"{ttl_ms - 1} milliseconds").alias("w"))


def on_close(
    sessions: DataFrame, events: Callable[[], DataFrame], derive: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    user: str = "user_id", time: str = "event_time", trigger: dict | None = None,
) -> StreamingQuery:
    """Run a batch operator over the stored events of each batch of closed sessions; results go to ``path``.

    The closed spans are written first, since the stateful plan behind them must run once only. Stored events are found by
    user and day, so a session meets the events of its own days and not all of the user's. Each batch writes its own
    folders, so a repeated batch replaces itself.
    """

    def run(closed: DataFrame, batch: int) -> None:
        spark = closed.sparkSession
        kept = f"{path}-spans/batch={batch}"
        closed.select(user, "started_at", "ended_at").write.mode("overwrite").parquet(kept)
        spans = spark.read.parquet(kept)
        edges = spans.agg(F.min("started_at"), F.max("ended_at")).first()
        if edges[0] is None:
            return
        days = F.sequence(F.to_date("started_at"), F.to_date("ended_at"))
        spans = spans.withColumn("__day", F.explode(days))
        stored = events().where(F.col(time).between(*edges)).withColumn("__day", F.to_date(time))
        rows = stored.join(spans, on=[user, "__day"]).where(F.col(time).between(F.col("started_at"), F.col("ended_at")))
        named = rows.withColumn("session_id", F.concat_ws("@", F.col(user).cast("string"), F.unix_millis("started_at").cast("string")))
        derive(named.drop("started_at", "ended_at", "__day")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
