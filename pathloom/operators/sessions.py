"""Sessions from raw events: timeout, order within the session, first touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.ordered import EVENT_ORDER, Keyed, known, lag, ordered, running_max, running_sum, sequenced

SESSION = ["session_id"]
ORDER = EVENT_ORDER
TTL_MS = 30 * 60 * 1000


def sessionize(
    events: DataFrame,
    user: str = "user_id",
    ttl_ms: int = TTL_MS,
    strict: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Number each user's sessions: a new one when idle for ``ttl_ms`` or longer (``strict``: longer).

    Adds session_no, session_id, event_seq, inter_event_gap, is_new_session and is_returning.
    """

    def build(k: Keyed) -> DataFrame:
        k = k.add(__prev=lag(F.col("timestamp")), __row=running_sum(F.lit(1).cast("long")))
        idle = F.col("timestamp") - F.col("__prev")
        opens = F.col("__prev").isNull() | (idle > ttl_ms if strict else idle >= ttl_ms)
        k = k.cols(is_new_session=opens, inter_event_gap=F.when(opens, F.lit(0).cast("long")).otherwise(idle))
        k = k.add(
            session_no=running_sum(F.col("is_new_session").cast("long")),
            # rows before the open session: the largest row number at a session start
            __start=running_max(F.when(F.col("is_new_session"), F.col("__row"))),
        )
        return k.cols(
            session_id=F.concat_ws("-", F.col(user).cast("string"), F.col("session_no").cast("string")),
            event_seq=F.col("__row") - F.col("__start") + 1,
            is_returning=F.col("session_no") > 1,
        ).df.drop("__prev", "__row", "__start")

    return ordered(events, [user], ORDER, build, bounded)


def event_seq(events: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = ORDER, bounded=False) -> DataFrame:
    return ordered(
        events, keys, order, lambda k: k.add(event_seq=running_sum(F.lit(1).cast("long"))).df, bounded
    )


def inter_event_gap(events: DataFrame, keys: Sequence[str] = SESSION, order: Sequence[str] = ORDER, bounded=False) -> DataFrame:
    """Milliseconds since the previous event of the session, 0 for the first and never negative."""

    def build(k: Keyed) -> DataFrame:
        k = k.add(__prev=lag(F.col("timestamp")))
        gap = F.greatest(F.lit(0).cast("long"), F.col("timestamp") - F.col("__prev"))
        return k.df.withColumn("inter_event_gap", F.coalesce(gap, F.lit(0).cast("long"))).drop("__prev")

    return ordered(events, keys, order, build, bounded)


def first_touch(events: DataFrame, columns: Sequence[str], keys: Sequence[str] = SESSION) -> DataFrame:
    """Attribution of the first event in event time, one row per session; arrival order does not matter."""
    events, order = sequenced(events, ORDER)
    rank = F.struct(*order)
    return events.groupBy(*keys).agg(*(F.min_by(c, rank).alias(c) for c in columns))


def carry_context(
    events: DataFrame, columns: dict[str, Column], keys: Sequence[str] = SESSION,
    order: Sequence[str] = ORDER, bounded: bool = False,
) -> DataFrame:
    """Carry the last non-null value of each expression forward within the session."""
    return ordered(
        events, keys, order, lambda k: k.add(**{n: known(c) for n, c in columns.items()}).df, bounded
    )
