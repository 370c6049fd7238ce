"""The event envelope and its typed payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()

PAYLOAD = T.StructType(
    [T.StructField(n, _S) for n in (
        "click_text", "click_target", "hover_text", "hover_target", "section", "element_section",
        "subsection_id", "subsection", "exit_page", "page_url", "product_id", "option_name",
        "option_value", "input_name", "search_query", "intent_id", "operation",
    )]
    + [T.StructField(n, _D) for n in (
        "depth_pct", "milestone", "scroll_depth_pct", "max_scroll_depth", "dwell_ms", "dwell_time_ms",
        "hover_dwell_time_ms", "distance_px", "jitter_count", "search_length", "revisit_count", "count",
        "last_viewport_scrollY", "scrollY", "position", "x", "y",
    )]
    + [
        T.StructField("click_position", T.StructType([T.StructField("x", _D), T.StructField("y", _D)])),
        T.StructField("bounce_flag", _B),
        T.StructField("navigation_path", T.ArrayType(_S)),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("session_id", _S),
        T.StructField("event_type", _S),
        T.StructField("event_token", T.IntegerType()),
        T.StructField("event_seq", _L),
        T.StructField("inter_event_gap", _L),
        T.StructField("timestamp", _L),
    ]
    + [T.StructField(n, _S) for n in (
        "page_url", "pathname", "referrer", "referrer_host", "landing_page", "device_type", "os_type",
        "browser_type", "platform", "page_type", "platform_role", "product_id", "utm_source", "utm_medium",
        "utm_campaign", "utm_term", "utm_content", "channel", "in_app_browser",
    )]
    + [
        T.StructField("screen_width", T.IntegerType()),
        T.StructField("product_price", T.DecimalType(18, 2)),
        T.StructField("data", _S),
        T.StructField("origin", _S),
    ]
)

# Event numbers shared with the collector; names outside the table get 0.
EVENT_NUMBERS = {
    "session_start": 1, "session_end": 2, "navigation": 3, "bounce": 4,
    "enter_category": 5, "enter_product": 6,
    "click": 10, "rage_click": 11,
    "mouse_move": 20, "hover_dwell": 21,
    "tab_exit": 30, "tab_return": 31,
    "input_change": 40, "field_focus": 41, "field_blur": 42, "input_abandon": 43,
    "paste_event": 44, "search_use": 45,
    "image_slide": 50, "image_zoom": 51, "video_play": 52, "video_watch_pct": 53,
    "scroll_depth": 60, "scroll_milestone": 61, "scroll_stop": 62,
    "scroll_direction_change": 63, "scroll_speed": 64,
    "section_enter": 70, "section_exit": 71, "section_revisit": 72, "section_transition": 73,
    "subsection_enter": 74, "subsection_exit": 75, "subsection_revisit": 76,
    "product_click": 80, "option_select": 81, "add_to_cart": 82, "remove_from_cart": 83,
    "purchase_click": 84, "cart_abandon_flag": 85, "quantity_change": 86, "option_change": 87,
    "inactivity": 90, "time_to_first_click": 91, "subsection_dwell": 92, "screen_resize": 93,
    "review_click": 94, "review_page_change": 95, "review_scroll": 96, "review_area_scroll": 97,
    "review_image_click": 98,
    "sdk_error": 0,
}


def event_number(event_type: Column) -> Column:
    from pathloom.functions.rules import lookup

    return F.coalesce(lookup(event_type, {k: str(v) for k, v in EVENT_NUMBERS.items()}).cast("int"), F.lit(0))


def parse_payload(data: Column) -> Column:
    """Payload text as typed columns. Single-quoted literals are read too; anything else gives nulls."""
    return F.from_json(
        data, PAYLOAD, {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    )


def slim(events: DataFrame, columns: Sequence[str], fields: Sequence[str], payload: str = "p") -> DataFrame:
    """Only the named columns and payload fields, so that a shuffle carries no more than what is read later."""
    kept = [c for c in dict.fromkeys(columns) if c in events.columns]
    return events.select(*kept, F.struct(*(F.col(payload)[f].alias(f) for f in fields)).alias(payload))


def scroll_position(p: Column, earlier: Column | None = None) -> Column:
    """First numeric scroll position of four names, not below 0, else the earlier one."""
    found = F.coalesce(p["last_viewport_scrollY"], p["scrollY"], p["position"], p["y"])
    # greatest() would turn "no position" into 0
    now = F.when(found.isNotNull(), F.greatest(F.lit(0), found.cast("long")))
    return F.coalesce(now, earlier) if earlier is not None else now
