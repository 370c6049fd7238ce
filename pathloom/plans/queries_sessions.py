"""Registered queries: sessions, rollups, operator summary, feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import features, rollups, sessions
from pathloom.plans.fixtures import DAY_MS, Clicks, clicks_sql, raw_clicks, table
from pathloom.plans.registry import query

HALF_HOUR_MS = 30 * 60 * 1000
CLICKS = "WITH " + clicks_sql()

ROLLUP_SQL = """
x0 AS (SELECT *, lower(concat(coalesce(pathname, ''), ' ', coalesce(page_url, ''))) AS txt,
       concat(coalesce(p_hover_text, ''), ' ', coalesce(p_click_text, '')) AS said,
       lower(coalesce(p_click_target, '')) AS target FROM clicks),
rollup_ AS (SELECT session_id,
  coalesce((array_agg(referrer ORDER BY received_at, event_id))[1], '') AS referrer,
  coalesce((array_agg(utm_source ORDER BY received_at, event_id))[1], '') AS utm_source,
  coalesce((array_agg(utm_medium ORDER BY received_at, event_id))[1], '') AS utm_medium,
  coalesce((array_agg(channel ORDER BY received_at, event_id))[1], '') AS channel,
  coalesce((array_agg(in_app_browser ORDER BY received_at, event_id))[1], '') AS in_app_browser,
  max(received_at) AS last_at,
  coalesce((array_agg(pathname ORDER BY received_at DESC, event_id DESC))[1], '/') AS pathname,
  count(*) AS "count",
  count(*) FILTER (event_type = 'tab_exit') AS tab_exit_hits,
  count(*) FILTER (event_type = 'inactivity') AS inactivity_hits,
  count(*) FILTER (regexp_matches(txt, 'cart|basket')) AS cart_hits,
  count(*) FILTER (regexp_matches(txt, 'checkout|payment|order')) AS checkout_hits,
  count(*) FILTER (event_type = 'search_use' OR regexp_matches(txt, 'search|category|collection')) AS search_hits,
  count(*) FILTER (event_type IN ('input_change', 'field_focus', 'field_blur')) AS input_hits,
  bool_or(contains(said, '주문이 완료') OR contains(target, 'complete')) AS completed,
  bool_or(event_type IN ('tab_exit', 'inactivity', 'session_end', 'cart_abandon_flag')) AS any_risk
  FROM x0 GROUP BY session_id),
rollup AS (SELECT * EXCLUDE (any_risk), any_risk AND NOT completed AS risky FROM rollup_)
"""
LABEL_SQL = """
l0 AS (SELECT *, lower(pathname) AS lp, coalesce(nullif(channel, ''), nullif(in_app_browser, ''), nullif(utm_source, ''),
   regexp_replace(regexp_extract(referrer, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '')) AS raw_source FROM rollup),
labelled AS (SELECT *,
  CASE WHEN regexp_matches(lp, 'checkout|payment|order') THEN '결제 화면'
       WHEN regexp_matches(lp, 'cart|basket') THEN '장바구니'
       WHEN regexp_matches(lp, 'product|item|prod_') THEN '상품 상세'
       WHEN regexp_matches(lp, 'search|category|collection') THEN '검색/카테고리' ELSE '홈 화면' END AS screen,
  CASE WHEN completed THEN '주문 성공' WHEN checkout_hits > 0 AND input_hits > 0 THEN '입력 도중 멈춤'
       WHEN cart_hits > 0 THEN '장바구니에서 멈춤' WHEN tab_exit_hits > 0 THEN '탭을 떠남'
       WHEN inactivity_hits > 0 THEN '화면을 보다가 멈춤' WHEN search_hits > 0 THEN '상품 탐색 중 멈춤'
       ELSE '마지막 화면에서 멈춤' END AS cause,
  CASE WHEN lower(trim(raw_source)) IN ('', 'direct') THEN '직접 방문'
       WHEN contains(lower(raw_source), 'notion') THEN 'Notion'
       WHEN contains(lower(raw_source), 'insta') THEN 'Instagram'
       WHEN contains(lower(raw_source), 'threads') THEN 'Threads'
       WHEN regexp_matches(lower(raw_source), 'facebook|fban') THEN 'Facebook'
       WHEN contains(lower(raw_source), 'github') THEN 'GitHub'
       WHEN contains(lower(raw_source), 'kakao') THEN 'Kakao'
       WHEN contains(lower(raw_source), 'google') THEN 'Google'
       WHEN contains(lower(raw_source), 'naver') THEN 'Naver'
       WHEN contains(lower(raw_source), 'daum') THEN 'Daum'
       WHEN contains(lower(raw_source), 'tiktok') THEN 'TikTok'
       WHEN contains(lower(raw_source), 'youtube') THEN 'YouTube'
       WHEN contains(lower(raw_source), 'line') THEN 'Line'
       ELSE regexp_replace(raw_source, '^www\\.', '', 'i') END AS source FROM l0)
"""
ROLLUP = f"{CLICKS}, {ROLLUP_SQL}"
LABELLED = f"{ROLLUP}, {LABEL_SQL}"

SESSION_COLUMNS = ["event_id", "user_id", "session_id", "session_no", "event_seq", "inter_event_gap", "is_new_session",
                   "is_returning"]


def rollup_of(spark, sf):
    return rollups.session_rollup(Clicks(spark, sf).df, Clicks.KEYS).drop("user_id")


@query("scan_events", f"""{CLICKS} SELECT event_id, session_id, event_type, received_at, origin FROM clicks
    WHERE origin IN ('https://site1', 'https://site1/') AND event_type = 'click' AND received_at > TIMESTAMP '2024-01-20'
    ORDER BY received_at DESC, event_id LIMIT 100""")
def scan_events(spark, sf):
    out = rollups.scan_events(
        Clicks(spark, sf).df, 100, event_type="click", since=F.lit("2024-01-20").cast("timestamp_ntz"), origin="HTTPS://site1/"
    )
    return out.select("event_id", "session_id", "event_type", "received_at", "origin")


@query("collection_scan", """SELECT event_id, user_id, epoch_us(ts) // 1000 AS "timestamp" FROM events""")
def collection_scan(spark, sf):
    return raw_clicks(spark, sf).select("event_id", "user_id", "timestamp")


_SESSION_SELECT = ", ".join(SESSION_COLUMNS)


@query("sessionize", f"{CLICKS} SELECT {_SESSION_SELECT} FROM clicks")
def sessionize(spark, sf):
    return Clicks(spark, sf).df.select(*SESSION_COLUMNS)


@query("sessionize_30min", f"WITH {clicks_sql(HALF_HOUR_MS)} SELECT {_SESSION_SELECT} FROM clicks")
def sessionize_30min(spark, sf):
    return Clicks(spark, sf, HALF_HOUR_MS).df.select(*SESSION_COLUMNS)


@query("session_rebuild_2min", f"""WITH {clicks_sql(DAY_MS)},
    g AS (SELECT event_id, user_id, "timestamp", CASE WHEN prev_t IS NULL OR "timestamp" - prev_t > 120000 THEN 1 ELSE 0 END AS o
          FROM e3)
    SELECT event_id, user_id, sum(o) OVER (PARTITION BY user_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING)
           AS session_no FROM g""")
def session_rebuild_2min(spark, sf):
    out = sessions.sessionize(raw_clicks(spark, sf), ttl_ms=120_000, strict=True)
    return out.select("event_id", "user_id", "session_no")


@query("orders_sessions", """WITH a AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000 AS t FROM orders),
    b AS (SELECT *, t - lag(t) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS gap FROM a),
    c AS (SELECT *, CASE WHEN gap IS NULL OR gap >= 2592000000 THEN 1 ELSE 0 END AS o FROM b),
    d AS (SELECT o_custkey, o_orderkey, t, sum(o) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey
          ROWS UNBOUNDED PRECEDING) AS n FROM c)
    SELECT o_custkey AS user_id, n AS session_no, count(*) AS orders, max(t) - min(t) AS span_ms FROM d GROUP BY ALL""")
def orders_sessions(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("event_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
    )
    out = sessions.sessionize(o, ttl_ms=30 * DAY_MS)
    return out.groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("orders"), (F.max("timestamp") - F.min("timestamp")).alias("span_ms")
    )


@query("event_seq", f"{CLICKS} SELECT event_id, event_seq FROM clicks")
def event_seq(spark, sf):
    c = Clicks(spark, sf)
    return sessions.event_seq(c.df.drop("event_seq"), Clicks.KEYS, bounded=c.bounded).select("event_id", "event_seq")


@query("inter_event_gap", f"{CLICKS} SELECT event_id, inter_event_gap FROM clicks")
def inter_event_gap(spark, sf):
    c = Clicks(spark, sf)
    out = sessions.inter_event_gap(c.df.drop("inter_event_gap"), Clicks.KEYS, bounded=c.bounded)
    return out.select("event_id", "inter_event_gap")


@query("session_rollup", f"{ROLLUP} SELECT * FROM rollup")
def session_rollup(spark, sf):
    return rollup_of(spark, sf)


@query("recent_sessions", f"{ROLLUP} SELECT * FROM rollup ORDER BY last_at DESC, session_id LIMIT 8")
def recent_sessions(spark, sf):
    return rollups.recent_sessions(rollup_of(spark, sf))


@query("session_labels", f"{LABELLED} SELECT session_id, screen, cause, source FROM labelled")
def session_labels(spark, sf):
    return rollups.labelled_rollup(rollup_of(spark, sf)).select("session_id", "screen", "cause", "source")


@query("source_counts", f"""{LABELLED} SELECT source AS name, count(*) AS "count" FROM labelled GROUP BY source
    ORDER BY 2 DESC, 1 LIMIT 3""")
def source_counts(spark, sf):
    return rollups.source_counts(rollup_of(spark, sf))


@query("blocked_screens", f"""{LABELLED}, c AS (SELECT screen AS label, count(*) AS "count" FROM labelled WHERE risky GROUP BY 1)
    SELECT label, "count", CAST(floor("count" * 100 / sum("count") OVER () + 0.5) AS BIGINT) AS share FROM c
    ORDER BY "count" DESC, label LIMIT 3""")
def blocked_screens(spark, sf):
    return rollups.top_share(rollups.rollup_facts(rollup_of(spark, sf)), "screen")


@query("issue_causes", f"""{LABELLED}, c AS (SELECT cause AS label, count(*) AS "count" FROM labelled WHERE risky GROUP BY 1)
    SELECT label, "count", CAST(floor("count" * 100 / sum("count") OVER () + 0.5) AS BIGINT) AS share FROM c
    ORDER BY "count" DESC, label LIMIT 3""")
def issue_causes(spark, sf):
    return rollups.top_share(rollups.rollup_facts(rollup_of(spark, sf)), "cause")


SOURCES_SQL = """
s0 AS (SELECT source, screen, count(*) AS n, count(*) FILTER (completed) AS c, count(*) FILTER (risky) AS r
       FROM labelled GROUP BY 1, 2),
sources AS (SELECT source AS name, CAST(sum(n) AS BIGINT) AS total, CAST(sum(c) AS BIGINT) AS completed,
       CAST(sum(r) AS BIGINT) AS risky, (array_agg(screen ORDER BY n DESC, screen))[1] AS top_page,
       CAST(floor(sum(c) * 100 / sum(n) + 0.5) AS BIGINT) AS completion_rate,
       CAST(floor(sum(r) * 100 / sum(n) + 0.5) AS BIGINT) AS risk_rate FROM s0 GROUP BY source
       ORDER BY total DESC, name LIMIT 4)
"""


@query("source_performance", f"{LABELLED}, {SOURCES_SQL} SELECT * FROM sources")
def source_performance(spark, sf):
    return rollups.source_performance(rollups.rollup_facts(rollup_of(spark, sf)))


@query("operator_summary", f"""{LABELLED}, {SOURCES_SQL},
    b0 AS (SELECT screen AS label, count(*) AS "count" FROM labelled WHERE risky GROUP BY 1),
    b AS (SELECT label, "count", CAST(floor("count" * 100 / sum("count") OVER () + 0.5) AS BIGINT) AS share,
          row_number() OVER (ORDER BY "count" DESC, label) AS "rank" FROM b0),
    i0 AS (SELECT cause AS label, count(*) AS "count" FROM labelled WHERE risky GROUP BY 1),
    i AS (SELECT label, "count", CAST(floor("count" * 100 / sum("count") OVER () + 0.5) AS BIGINT) AS share,
          row_number() OVER (ORDER BY "count" DESC, label) AS "rank" FROM i0),
    w AS (SELECT * FROM sources WHERE total >= 3 ORDER BY risk_rate DESC, total DESC, name LIMIT 1)
    SELECT 'blocked_pages' AS part, "rank", label, "count", share, '' AS detail FROM b WHERE "rank" <= 3
    UNION ALL SELECT 'issue_causes', "rank", label, "count", share, '' FROM i WHERE "rank" <= 3
    UNION ALL SELECT 'sources', row_number() OVER (ORDER BY total DESC, name), name, total, risk_rate, top_page FROM sources
    UNION ALL SELECT 'priorities', 1, concat(label, ' 점검'), "count", share, '' FROM b WHERE "rank" = 1
    UNION ALL SELECT 'priorities', 2, concat(label, ' 대응'), "count", share, '' FROM i WHERE "rank" = 1
    UNION ALL SELECT 'priorities', 3, concat(name, ' 유입 보강'), total, risk_rate, '' FROM w
    UNION ALL SELECT 'totals', 1, 'sessions', count(*), count(*) FILTER (risky), '' FROM rollup""")
def operator_summary(spark, sf):
    return rollups.operator_summary(rollup_of(spark, sf))


@query("event_type_counts", f"""{CLICKS} SELECT event_type, count(*) AS "count" FROM clicks GROUP BY 1""")
def event_type_counts(spark, sf):
    return rollups.event_type_counts(raw_clicks(spark, sf))


@query("distinct_sites", f"{CLICKS} SELECT DISTINCT origin FROM clicks")
def distinct_sites(spark, sf):
    return rollups.distinct_sites(raw_clicks(spark, sf))


@query("kpi_stats", f"""{CLICKS}, n AS (SELECT TIMESTAMP '2024-01-30 12:00:00' AS now)
    SELECT count(*) AS total, count(DISTINCT session_id) AS visitor_count,
           count(*) FILTER (received_at >= now - INTERVAL 1 HOUR) AS last_hour,
           count(DISTINCT session_id) FILTER (received_at >= now - INTERVAL 30 MINUTE) AS active_sessions
    FROM clicks, n""")
def kpi_stats(spark, sf):
    return rollups.kpi_stats(Clicks(spark, sf).df, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("origin_filter", f"""{CLICKS} SELECT origin, count(*) AS n FROM clicks
    WHERE regexp_replace(lower(origin), '/$', '') = 'https://site2' AND received_at >= TIMESTAMP '2024-01-05'
          AND received_at <= TIMESTAMP '2024-01-09 23:59:59' GROUP BY 1""")
def origin_filter(spark, sf):
    from pathloom.functions.urls import origin_matches
    from pathloom.operators.reports import between_days

    e = raw_clicks(spark, sf)
    kept = e.where(origin_matches(F.col("origin"), "https://Site2/") & between_days(F.col("received_at"), "2024-01-05", "2024-01-09"))
    return kept.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("valid_events", """SELECT conv_id, turn, role AS event_type FROM conversations WHERE role IS NOT NULL AND role <> 'system'""")
def valid_events(spark, sf):
    from pathloom.sources.events import valid

    # system turns carry no event type
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("event_type")
    )
    return valid(rows)


def _count_of(event: str) -> str:
    return f"count(*) FILTER (event_type = '{event}')"


def _even(numer: str, unit: int) -> str:
    """numer / unit rounded half to even, in integers."""
    n, q = f"CAST({numer} AS BIGINT)", f"(CAST({numer} AS BIGINT) // {unit})"
    r = f"({n} % {unit})"
    return f"({q} + CASE WHEN 2 * {r} > {unit} OR (2 * {r} = {unit} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


FEATURES_SQL = f"""
f0 AS (SELECT session_id,
  {", ".join(f"{_count_of(e)} AS {n}" for n, e in features.COUNTS.items())},
  {", ".join(f"CAST({_count_of(e)} > 0 AS INTEGER) AS {n}" for n, e in features.FLAGS.items())},
  greatest({_count_of('navigation')}, 1) AS page_count, {_count_of('purchase_click')} AS buys,
  CASE WHEN count(*) >= 2 THEN {_even('max("timestamp") - min("timestamp")', 100)} / 10.0 ELSE 0 END AS dwell_time_sec,
  coalesce(round_even(avg(nullif(inter_event_gap, 0)), 1), 0) AS inter_event_gap_avg,
  coalesce(max(CASE WHEN event_type = 'scroll_depth' THEN p_depth_pct END), 0) AS scroll_depth_max,
  coalesce(sum(p_distance_px), 0) AS mouse_distance_total, coalesce(sum(p_jitter_count), 0) AS mouse_jitter_total,
  coalesce(round_even(avg(p_hover_dwell_time_ms), 0), 0) AS hover_dwell_avg_ms,
  coalesce(round_even(avg(p_search_length), 1), 0) AS search_length_avg,
  (array_agg(device_type ORDER BY "timestamp", event_id))[1] AS device_type,
  coalesce(nullif((array_agg(utm_source ORDER BY "timestamp", event_id))[1], ''), 'direct') AS utm_source,
  (array_agg(origin ORDER BY "timestamp", event_id))[1] AS origin
  FROM clicks GROUP BY session_id),
features AS (SELECT * EXCLUDE (buys), CAST(page_count <= 1 AND dwell_time_sec < 30 AS INTEGER) AS bounce_flag,
  CAST(page_count <= 1 AND dwell_time_sec < 30 AS INTEGER) AS is_bounce,
  CAST(add_to_cart_count > 0 AS INTEGER) AS add_to_cart_flag, CAST(buys > 0 AS INTEGER) AS purchase_click_flag,
  CAST(add_to_cart_count > 0 AND buys = 0 AS INTEGER) AS cart_abandon_flag,
  CAST(add_to_cart_count > 0 AND remove_from_cart_count > 0 AS INTEGER) AS cart_indecision_flag,
  CAST(add_to_cart_count = 0 AND buys = 0 AS INTEGER) AS is_churned FROM f0)
"""


@query("session_features", f"{CLICKS}, {FEATURES_SQL} SELECT * FROM features")
def session_features(spark, sf):
    return features.session_features(Clicks(spark, sf).df, Clicks.KEYS)


@query("churn_labels", f"""{CLICKS} SELECT session_id, CAST(NOT bool_or(event_type IN ('add_to_cart', 'purchase_click'))
    AS INTEGER) AS is_churned FROM clicks GROUP BY 1""")
def churn_labels(spark, sf):
    return features.churn_labels(Clicks(spark, sf).df, Clicks.KEYS).drop("user_id")


@query("label_distribution", f"""{CLICKS}, {FEATURES_SQL}, n AS (SELECT is_churned, count(*) AS n FROM features GROUP BY 1)
    SELECT is_churned, n, round(n * 100 / sum(n) OVER (), 1) AS pct FROM n""")
def label_distribution(spark, sf):
    return features.label_distribution(features.churn_labels(Clicks(spark, sf).df, Clicks.KEYS), "is_churned")


@query("first_touch", f"""{CLICKS} SELECT session_id, (array_agg(utm_source ORDER BY "timestamp", event_id))[1] AS utm_source,
    (array_agg(channel ORDER BY "timestamp", event_id))[1] AS channel,
    (array_agg(pathname ORDER BY "timestamp", event_id))[1] AS pathname FROM clicks GROUP BY 1""")
def first_touch(spark, sf):
    return sessions.first_touch(Clicks(spark, sf).df, ["utm_source", "channel", "pathname"], Clicks.KEYS).drop("user_id")
