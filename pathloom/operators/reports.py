"""Exit hotspots and the conversion funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import urls
from pathloom.functions.pages import scroll_bucket_px
from pathloom.functions.payload import scroll_position, slim
from pathloom.functions.rules import blank_to_null
from pathloom.operators.ordered import Keyed, known, ordered
from pathloom.operators.sessions import SESSION
from pathloom.session import cut

# Events that end a visit, and events that tell where the visitor was.
EXIT_EVENTS = ["session_end", "tab_exit", "inactivity"]
PLACE_EVENTS = [
    "section_enter", "section_exit", "section_transition", "subsection_enter", "subsection_exit", "scroll_stop",
    "scroll_depth", "click", "hover_dwell", "product_click", "add_to_cart", "purchase_click", "remove_from_cart",
]


EXIT_FIELDS = [
    "page_url", "exit_page", "section", "element_section", "subsection_id", "subsection", "last_viewport_scrollY", "scrollY", "position", "y",
]


def between_days(at: Column, first: str, last: str) -> Column:
    """From the start of the first day to the last second of the last day."""
    return at.between(F.lit(first).cast("timestamp_ntz"), F.lit(f"{last} 23:59:59").cast("timestamp_ntz"))


def exit_places(
    events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", order: Sequence[str] = ("event_seq", "timestamp", "event_id"),
    bounded: bool = False,
) -> DataFrame:
    """Every exit with the URL, section and scroll position known at that moment.

    The site part and the path part of the URL are carried apart, because an exit page replaces only
    the path. Exits without an absolute URL are left out.
    """
    p = F.col(payload)
    own = urls.clean_fragment_url(F.coalesce(blank_to_null(F.col("page_url")), blank_to_null(p["page_url"]), F.lit("")))
    rows = events.where(F.col("event_type").isin([*EXIT_EVENTS, *PLACE_EVENTS]))
    rows = slim(rows, [*keys, *order, "event_id", "event_type", "page_url"], EXIT_FIELDS, payload).withColumn("__own", blank_to_null(own))
    site = F.regexp_extract("__own", r"^([^:/?#]+://[^/?#]*)", 1)
    page = F.when(p["exit_page"].startswith("/"), p["exit_page"])
    tail = F.coalesce(page, F.substring(F.col("__own"), F.length(site) + 1, F.length("__own")))

    def build(k: Keyed) -> DataFrame:
        k = k.add(
            __site=known(site),
            __tail=known(tail),
            __section=known(F.coalesce(blank_to_null(p["section"]), blank_to_null(p["element_section"]))),
            __subsection=known(F.coalesce(blank_to_null(p["subsection_id"]), blank_to_null(p["subsection"]))),
            __scroll=known(scroll_position(p)),
        )
        return k.df

    out = ordered(rows, keys, list(order), build, bounded).where(F.col("event_type").isin(EXIT_EVENTS))
    return out.select(
        *keys, "event_id", "event_type",
        F.concat("__site", "__tail").alias("url"),
        F.coalesce("__section", "__subsection", F.lit("unknown")).alias("section"),
        F.coalesce("__scroll", F.lit(0).cast("long")).alias("scroll_y"),
    ).where(F.col("url").rlike("^https?://"))


def exit_hotspots(exits: DataFrame, limit: int | None = 3) -> DataFrame:
    """Where visits end most: exits per URL, section and 500-px stretch, with their share of all exits."""
    by_type = exits.groupBy("url", "section", scroll_bucket_px(F.col("scroll_y")).alias("scroll_bucket"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("scroll_y").alias("y")
    )
    spots = cut(
        by_type.groupBy("url", "section", "scroll_bucket").agg(
            F.sum("n").alias("count"),
            F.floor(F.sum("y") / F.sum("n")).alias("scroll_y"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("event_types"),
        )
    )
    total = spots.agg(F.sum("count").alias("n")).select("n")
    out = spots.withColumn("share_pct", F.bround(F.col("count") * 100 / total.scalar()).cast("long"))
    return out.orderBy(F.desc("count"), "url", "section", "scroll_bucket").limit(limit) if limit else out


# Stages of the funnel, and the group of sessions without a named type.
FUNNEL_STAGES = ["방문", "상품 조회", "장바구니", "결제 도달", "구매 클릭"]
UNNAMED = "미분류"


def furthest_stage(long: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Deepest stage (0 to 4) that a session's tokens show; earlier ones are not required."""
    parts = F.split("token", r"\|")
    page, semantic = parts[0], parts[1]
    stage = (
        F.when(F.size(parts) != 3, 0)
        .when(semantic == "CLICK_BUY", 4)
        .when(page == "CHECKOUT", 3)
        .when(semantic.isin("ADD_CART", "ENTER_CART") | (page == "CART"), 2)
        .when((page == "PRODUCT") | (semantic == "VIEW_PRODUCT"), 1)
        .otherwise(0)
    )
    return long.groupBy(*keys).agg(F.max(stage).alias("stage"))


def named_stages(stages: DataFrame, assignments: DataFrame, names: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Sessions → cluster → type name, unnamed where either is missing."""
    out = stages.join(assignments.select(*keys, "cluster"), on=list(keys), how="left")
    out = out.join(names.select("cluster", "name"), on="cluster", how="left")
    return out.withColumn("name", F.coalesce("name", F.lit(UNNAMED)))


def stage_counts(named: DataFrame) -> DataFrame:
    """Sessions per type and deepest stage: all the funnel needs, at most five rows per type."""
    return named.groupBy("name", "stage").agg(F.count(F.lit(1)).alias("n"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part * 100 / whole)).otherwise(0).cast("long")


def funnel(counts: DataFrame) -> DataFrame:
    """Sessions that reach each stage, with rates, losses to the stage before and the biggest loss."""
    levels = F.explode(F.sequence(F.lit(0), F.col("stage"))).alias("level")
    reach = counts.select(levels, "n").groupBy("level").agg(F.sum("n").alias("reach"))
    zero = counts.sparkSession.range(len(FUNNEL_STAGES)).select(F.col("id").cast("int").alias("level"), F.lit(0).cast("long").alias("reach"))
    full = reach.unionByName(zero).groupBy("level").agg(F.sum("reach").alias("reach"))
    w = Window.partitionBy().orderBy("level")  # five rows
    before = F.lag("reach").over(w)
    out = full.select(
        "level", "reach",
        _percent(F.col("reach"), F.max("reach").over(Window.partitionBy())).alias("rate"),
        (before - F.col("reach")).alias("drop"),
        _percent(before - F.col("reach"), before).alias("drop_rate"),
    )
    worst = F.max_by(F.col("level"), F.struct("drop", -F.col("level"))).over(Window.partitionBy())
    names = F.array(*map(F.lit, FUNNEL_STAGES))
    return out.select(
        names[F.col("level")].alias("stage"), "level", "reach", "rate",
        F.when(F.col("level") > 0, F.col("drop")).alias("drop"),
        F.when(F.col("level") > 0, F.col("drop_rate")).alias("drop_rate"),
        (F.col("level") == worst).alias("biggest"),
    )


def funnel_by_type(counts: DataFrame) -> DataFrame:
    """Rates per type, and how many sessions stall right before the biggest loss.

    ``leak_type`` marks the type that loses most there: a named one, or the unnamed group when no
    named type stalls; none when nobody does.
    """
    counts = cut(counts)
    leak = funnel(counts).where("biggest").select(F.col("level") - 1).scalar()

    def at_least(level: int) -> Column:
        return F.sum(F.when(F.col("stage") >= level, F.col("n")).otherwise(0))

    stalled = F.sum(F.when(F.col("stage") == F.col("__leak"), F.col("n")).otherwise(0))
    total = F.sum("n")
    out = counts.withColumn("__leak", leak).groupBy("name").agg(
        total.alias("n"),
        _percent(at_least(2), total).alias("cart_rate"),
        _percent(at_least(3), total).alias("chk_rate"),
        _percent(at_least(4), total).alias("buy_rate"),
        stalled.alias("stall_leak"),
    )
    everyone = Window.partitionBy()  # one row per type
    named = F.col("name") != UNNAMED
    by_name = F.min_by(F.col("name"), F.when(named & (F.col("stall_leak") > 0), F.struct(-F.col("stall_leak"), F.col("name")))).over(everyone)
    unnamed = F.max(F.when(~named & (F.col("stall_leak") > 0), F.col("name"))).over(everyone)
    return out.withColumn("leak_type", F.coalesce(F.col("name") == F.coalesce(by_name, unnamed), F.lit(False)))


# Grades of the will to buy.
HIGH, MEDIUM, LOW = "높음", "중간", "낮음"


def intent_from_funnel(buy_rate: Column, mean_rate: Column) -> Column:
    """Grade of a type's buy rate against the mean of all sessions."""
    return (
        F.when(buy_rate >= F.greatest(mean_rate * 1.2, F.lit(15.0)), F.lit(HIGH))
        .when(buy_rate <= mean_rate * 0.6, F.lit(LOW))
        .otherwise(F.lit(MEDIUM))
    )
