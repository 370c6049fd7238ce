"""One row per session, and the operator's summaries over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.pages import path_and_url, screen_label
from pathloom.functions.rules import blank_to_null
from pathloom.functions.tokens import order_succeeded
from pathloom.functions.urls import source_name
from pathloom.operators.sessions import SESSION
from pathloom.session import cut

# Events that hint at a visitor giving up.
RISK_EVENTS = ["tab_exit", "inactivity", "session_end", "cart_abandon_flag"]
INPUT_EVENTS = ["input_change", "field_focus", "field_blur"]
CAUSES = {
    "done": "주문 성공",
    "input": "입력 도중 멈춤",
    "cart": "장바구니에서 멈춤",
    "tab": "탭을 떠남",
    "idle": "화면을 보다가 멈춤",
    "search": "상품 탐색 중 멈춤",
    "other": "마지막 화면에서 멈춤",
}
FIRST_TOUCH = {
    "referrer": "referrer",
    "utm_source": "utm_source",
    "utm_medium": "utm_medium",
    "utm_campaign": "utm_campaign",
    "channel": "channel",
    "in_app_browser": "in_app_browser",
    "landing_page": "landing_page",
}


def session_rollup(events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p") -> DataFrame:
    """First touch, last place, hit counters, completed and risky: one aggregation, combined map-side."""
    order = F.struct("received_at", "event_id")
    text = path_and_url(F.col("pathname"), F.col("page_url"))
    kind = F.col("event_type")
    touch = {n: c for n, c in FIRST_TOUCH.items() if c in events.columns}
    out = events.groupBy(*keys).agg(
        *(F.coalesce(F.min_by(c, order), F.lit("")).alias(n) for n, c in touch.items()),
        F.max("received_at").alias("last_at"),
        F.coalesce(F.max_by("pathname", order), F.lit("/")).alias("pathname"),
        F.count(F.lit(1)).alias("count"),
        F.count_if(kind == "tab_exit").alias("tab_exit_hits"),
        F.count_if(kind == "inactivity").alias("inactivity_hits"),
        F.count_if(text.rlike("cart|basket")).alias("cart_hits"),
        F.count_if(text.rlike("checkout|payment|order")).alias("checkout_hits"),
        F.count_if((kind == "search_use") | text.rlike("search|category|collection")).alias("search_hits"),
        F.count_if(kind.isin(INPUT_EVENTS)).alias("input_hits"),
        F.count_if(kind.isin(RISK_EVENTS)).alias("__risk"),
        F.bool_or(F.coalesce(order_succeeded(F.col(payload)), F.lit(False))).alias("completed"),
    )
    return out.withColumn("risky", ~F.col("completed") & (F.col("__risk") > 0)).drop("__risk")


def cause_label() -> Column:
    """Most likely reason why a session stopped, over the rollup's counters."""
    return (
        F.when(F.col("completed"), F.lit(CAUSES["done"]))
        .when((F.col("checkout_hits") > 0) & (F.col("input_hits") > 0), F.lit(CAUSES["input"]))
        .when(F.col("cart_hits") > 0, F.lit(CAUSES["cart"]))
        .when(F.col("tab_exit_hits") > 0, F.lit(CAUSES["tab"]))
        .when(F.col("inactivity_hits") > 0, F.lit(CAUSES["idle"]))
        .when(F.col("search_hits") > 0, F.lit(CAUSES["search"]))
        .otherwise(F.lit(CAUSES["other"]))
    )


def labelled_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "*",
        screen_label(F.col("pathname")).alias("screen"),
        cause_label().alias("cause"),
        source_name(
            F.col("channel"), F.col("in_app_browser"), F.col("utm_source"), F.col("referrer")
        ).alias("source"),
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; 0 when there is nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + F.lit(0.5))).otherwise(F.lit(0)).cast("long")


def rollup_facts(rollup: DataFrame) -> DataFrame:
    """Sessions counted by source, screen, cause and outcome: everything the summaries need, and small."""
    return (
        labelled_rollup(rollup)
        .groupBy("source", "screen", "cause", "completed", "risky")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_share(facts: DataFrame, label: str, k: int = 3) -> DataFrame:
    """Top labels of the risky sessions with their share of all risky sessions."""
    counts = facts.where("risky").groupBy(label).agg(F.sum("n").alias("count"))
    # screens and causes are fixed vocabularies, so this window sees at most a few rows
    shares = counts.withColumn("share", percent(F.col("count"), F.sum("count").over(Window.partitionBy())))
    return shares.orderBy(F.desc("count"), F.asc(label)).limit(k).withColumnRenamed(label, "label")


def source_performance(facts: DataFrame, k: int | None = 4) -> DataFrame:
    """Sources by sessions with completion and risk rates and the screen seen last most often."""
    by_screen = facts.groupBy("source", "screen").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("completed"), F.col("n")).otherwise(0)).alias("c"),
        F.sum(F.when(F.col("risky"), F.col("n")).otherwise(0)).alias("r"),
    )
    out = by_screen.groupBy("source").agg(
        F.sum("n").alias("total"),
        F.sum("c").alias("completed"),
        F.sum("r").alias("risky"),
        F.min_by("screen", F.struct(-F.col("n"), F.col("screen"))).alias("top_page"),
    )
    out = out.withColumns(
        {
            "completion_rate": percent(F.col("completed"), F.col("total")),
            "risk_rate": percent(F.col("risky"), F.col("total")),
        }
    ).withColumnRenamed("source", "name")
    return out.orderBy(F.desc("total"), F.asc("name")).limit(k) if k else out


def operator_summary(rollup: DataFrame) -> DataFrame:
    """Blocked screens, causes, sources and priorities as rows of one table: (part, rank, label, …)."""
    # five small reports read the facts, the events are read once
    facts = cut(rollup_facts(rollup))

    def part(name: str, df: DataFrame, label: str, count: str, share: str, detail: Column) -> DataFrame:
        w = Window.partitionBy(F.lit(name)).orderBy(F.desc(count), F.asc(label))
        return df.select(
            F.lit(name).alias("part"),
            F.row_number().over(w).alias("rank"),
            F.col(label).alias("label"),
            F.col(count).cast("long").alias("count"),
            F.col(share).cast("long").alias("share"),
            detail.alias("detail"),
        )

    def advice(rank: int, df: DataFrame, suffix: str) -> DataFrame:
        return df.select(
            F.lit("priorities").alias("part"), F.lit(rank).alias("rank"),
            F.concat("label", F.lit(suffix)).alias("label"), "count", "share", F.lit("").alias("detail"),
        )

    screens = part("blocked_pages", top_share(facts, "screen"), "label", "count", "share", F.lit(""))
    causes = part("issue_causes", top_share(facts, "cause"), "label", "count", "share", F.lit(""))
    best = source_performance(facts)
    sources = part("sources", best, "name", "total", "risk_rate", F.col("top_page"))
    worst = best.where("total >= 3").orderBy(F.desc("risk_rate"), F.desc("total"), F.asc("name")).limit(1).select(
        F.col("name").alias("label"), F.col("total").alias("count"), F.col("risk_rate").alias("share")
    )
    totals = facts.select(
        F.lit("totals").alias("part"), F.lit(1).alias("rank"), F.lit("sessions").alias("label"),
        F.col("n"), F.when(F.col("risky"), F.col("n")).otherwise(0).alias("r"), F.lit("").alias("detail"),
    ).groupBy("part", "rank", "label", "detail").agg(F.sum("n").alias("count"), F.sum("r").alias("share"))
    out = screens.unionByName(causes).unionByName(sources).unionByName(totals)
    out = out.unionByName(advice(1, screens.where("rank = 1"), " 점검"))
    out = out.unionByName(advice(2, causes.where("rank = 1"), " 대응"))
    return out.unionByName(advice(3, worst, " 유입 보강"))


def source_counts(rollup: DataFrame, k: int = 3) -> DataFrame:
    """Sessions per source, the top ``k``."""
    counts = rollup_facts(rollup).groupBy(F.col("source").alias("name")).agg(F.sum("n").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("name")).limit(k)


def recent_sessions(rollup: DataFrame, k: int = 8) -> DataFrame:
    """Sessions by last activity, the newest ``k``."""
    return rollup.orderBy(F.desc("last_at"), F.asc("session_id")).limit(k)


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))


def distinct_sites(events: DataFrame) -> DataFrame:
    return events.where(blank_to_null(F.col("origin")).isNotNull()).select("origin").distinct()


def kpi_stats(events: DataFrame, now: Column) -> DataFrame:
    """Totals, visitors, last hour and sessions active in the last half hour, from one pass.

    Counted per session first, so that no distinct set is held anywhere.
    """
    at = F.col("received_at")
    per_session = events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(at >= now - F.expr("INTERVAL 1 HOUR")).alias("hour"),
        F.max(at).alias("last"),
    )
    return per_session.agg(
        F.sum("n").alias("total"),
        F.count(blank_to_null(F.col("session_id"))).alias("visitor_count"),
        F.sum("hour").alias("last_hour"),
        F.count_if(F.col("last") >= now - F.expr("INTERVAL 30 MINUTES")).alias("active_sessions"),
    )


def scan_events(
    events: DataFrame, limit: int | None = None, event_type: str | None = None, session_id: str | None = None,
    since: Column | None = None, origin: str | None = None,
) -> DataFrame:
    """Newest events first, all or the first ``limit``; ``since`` is exclusive."""
    from pathloom.functions.urls import origin_filter

    out = events.where(origin_filter(F.col("origin"), origin)) if origin else events
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if session_id:
        out = out.where(F.col("session_id") == session_id)
    if since is not None:
        out = out.where(F.col("received_at") > since)
    out = out.orderBy(F.desc("received_at"), F.asc("event_id"))
    return out if limit is None else out.limit(limit)
