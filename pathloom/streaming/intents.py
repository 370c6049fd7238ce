"""Intents and their outcomes as a join of two streams within a bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.behaviour import OUTCOMES


def intent_pairs(
    events: DataFrame, within_ms: int, outcomes: dict[str, Sequence[str]] = OUTCOMES, user: str = "user_id", time: str = "event_time",
    delay: str = "10 minutes",
) -> DataFrame:
    """(user, intent, timestamp, event_id, outcome) of each intent with every outcome of its kind less than ``within_ms`` later.

    Both sides have a watermark and the bound is part of the join, so either side's state lasts no longer than bound and delay. An intent
    without outcome comes out, with a null, once its bound is over.
    """
    kind = F.lit(None).cast("string")
    for intent, closing in outcomes.items():
        kind = F.when(F.col("event_type").isin(intent, *closing), F.lit(intent)).otherwise(kind)
    # the condition names the time, else Spark would filter before the watermark and silence in one kind would hold it back
    kind = F.when(F.col(time).isNotNull(), kind)
    rows = events.withWatermark(time, delay).withColumn("intent", kind).where(F.col("intent").isNotNull())
    opens = F.col("event_type") == F.col("intent")
    left = rows.where(opens).select(user, "intent", time, "timestamp", "event_id").alias("i")
    right = rows.where(~opens).select(
        F.col(user).alias("__user"), F.col("intent").alias("__intent"), F.col(time).alias("__time"),
        F.struct("timestamp", "event_id", "event_type").alias("outcome"),
    )
    after = F.struct("outcome.timestamp", "outcome.event_id") > F.struct("timestamp", "event_id")
    near = (F.col("__time") >= F.col(time)) & (F.col("__time") < F.col(time) + F.expr(f"INTERVAL {within_ms} MILLISECONDS"))
    same = (F.col(user) == F.col("__user")) & (F.col("intent") == F.col("__intent"))
    return left.join(right, same & near & after, "left_outer").select(user, "intent", "timestamp", "event_id", "outcome")


def resolved(pairs: DataFrame, user: str = "user_id") -> DataFrame:
    """One row per intent: an outcome belongs to the latest intent before it, an intent has its first outcome.

    Two aggregations with map-side combine over the stored pairs; no list of a user's intents.
    """
    intent = [user, "intent"]
    own = pairs.where(F.col("outcome").isNotNull()).groupBy(*intent, "outcome").agg(F.max(F.struct("timestamp", "event_id")).alias("at"))
    first = own.groupBy(*intent, "at").agg(F.min("outcome").alias("outcome")).select(*intent, "at.timestamp", "at.event_id", "outcome")
    every = pairs.select(*intent, "timestamp", "event_id").distinct()
    return every.join(first, [*intent, "timestamp", "event_id"], "left").select(
        *intent, "timestamp", "event_id", F.col("outcome.event_type").alias("outcome"),
        (F.col("outcome.timestamp") - F.col("timestamp")).alias("wait_ms"),
    )
