"""The wide session feature table: 39 columns from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.rules import blank_to_null
from pathloom.operators.sessions import SESSION

# Feature column and the event it counts.
COUNTS = {
    "click_count": "click",
    "scroll_direction_change_count": "scroll_direction_change",
    "scroll_stop_count": "scroll_stop",
    "hover_count": "hover_dwell",
    "tab_exit_count": "tab_exit",
    "search_count": "search_use",
    "input_abandon_count": "input_abandon",
    "paste_count": "paste_event",
    "product_click_count": "product_click",
    "add_to_cart_count": "add_to_cart",
    "remove_from_cart_count": "remove_from_cart",
    "option_change_count": "option_change",
    "quantity_change_count": "quantity_change",
    "review_click_count": "review_click",
    "review_page_change_count": "review_page_change",
    "review_image_click_count": "review_image_click",
    "image_slide_count": "image_slide",
}
FLAGS = {"rage_click_flag": "rage_click", "review_scroll_flag": "review_scroll", "video_play_flag": "video_play"}


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def session_features(events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p") -> DataFrame:
    p, kind = F.col(payload), F.col("event_type")

    def of(event: str, field: str) -> Column:
        """Payload value of one event type, 0 when that event lacks it."""
        return F.when(kind == event, F.coalesce(p[field], F.lit(0.0)))

    at = F.nullif(F.col("timestamp"), F.lit(0))
    gap = F.nullif(F.col("inter_event_gap"), F.lit(0))
    rank = F.struct("timestamp", "event_id")
    zero = F.lit(0.0)
    raw = events.where(F.col("session_id") != "").groupBy(*keys).agg(
        *(F.count_if(kind == event).alias(name) for name, event in COUNTS.items()),
        *(_flag(F.bool_or(kind == event)).alias(name) for name, event in FLAGS.items()),
        F.count_if(kind == "navigation").alias("__pages"),
        F.count_if(kind == "purchase_click").alias("__buys"),
        F.count(at).alias("__n"),
        (F.max(at) - F.min(at)).alias("__span"),
        F.coalesce(F.bround(F.avg(gap), 1), zero).alias("inter_event_gap_avg"),
        F.coalesce(F.max(of("scroll_depth", "depth_pct")), zero).alias("scroll_depth_max"),
        F.coalesce(F.bround(F.sum(of("mouse_move", "distance_px"))), zero).alias("mouse_distance_total"),
        F.coalesce(F.sum(of("mouse_move", "jitter_count")), zero).alias("mouse_jitter_total"),
        F.coalesce(F.bround(F.avg(of("hover_dwell", "hover_dwell_time_ms"))), zero).alias("hover_dwell_avg_ms"),
        F.coalesce(F.bround(F.avg(of("search_use", "search_length")), 1), zero).alias("search_length_avg"),
        F.min_by(F.struct("device_type", "utm_source", "origin"), rank).alias("__first"),
    )
    pages = F.greatest(F.col("__pages"), F.lit(1))
    dwell = F.when(F.col("__n") >= 2, F.bround(F.col("__span") / 1000, 1)).otherwise(zero)
    cart, bought = F.col("add_to_cart_count") > 0, F.col("__buys") > 0
    bounced = _flag((pages <= 1) & (dwell < 30))
    return raw.withColumns(
        {
            "page_count": pages,
            "dwell_time_sec": dwell,
            "bounce_flag": bounced,
            "add_to_cart_flag": _flag(cart),
            "purchase_click_flag": _flag(bought),
            "cart_abandon_flag": _flag(cart & ~bought),
            "cart_indecision_flag": _flag(cart & (F.col("remove_from_cart_count") > 0)),
            "device_type": F.coalesce(F.col("__first.device_type"), F.lit("unknown")),
            "utm_source": F.coalesce(blank_to_null(F.col("__first.utm_source")), F.lit("direct")),
            "origin": F.coalesce(F.col("__first.origin"), F.lit("")),
            "is_churned": _flag(~cart & ~bought),
            "is_bounce": bounced,
        }
    ).drop("__pages", "__buys", "__n", "__span", "__first", *(k for k in keys if k != "session_id"))


def churn_labels(events: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Session, and 1 when it neither filled a cart nor bought; one pass instead of an anti-join."""
    kept = F.col("event_type").isin("add_to_cart", "purchase_click")
    return events.groupBy(*keys).agg((~F.bool_or(kept)).cast("int").alias("is_churned"))


def label_distribution(rows: DataFrame, label: str) -> DataFrame:
    """Rows and percent per class; a handful of classes."""
    from pyspark.sql import Window

    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 1))
