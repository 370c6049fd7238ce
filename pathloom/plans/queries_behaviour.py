"""Registered queries: behaviour derived from the order of a session's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import behaviour as b, sessions as ss
from pathloom.plans.fixtures import Clicks, clicks_sql, table
from pathloom.plans.registry import query

CLICKS = "WITH " + clicks_sql()
W = 'PARTITION BY session_id ORDER BY "timestamp", event_id'
UPTO = f"({W} ROWS UNBOUNDED PRECEDING)"
KEYS = Clicks.KEYS


@query("time_to_first_click", f"""{CLICKS}, v AS (SELECT *,
      sum(CASE WHEN event_type IN ('navigation', 'session_start') THEN 1 ELSE 0 END) OVER {UPTO} AS visit FROM clicks),
    e AS (SELECT session_id, visit, min("timestamp") AS enter_ts FROM v WHERE visit > 0 GROUP BY ALL),
    c AS (SELECT session_id, visit, min("timestamp") AS click_ts FROM v WHERE event_type = 'click' GROUP BY ALL)
    SELECT session_id, visit, click_ts - enter_ts AS duration_ms FROM e JOIN c USING (session_id, visit)""")
def time_to_first_click(spark, sf):
    c = Clicks(spark, sf)
    return b.time_to_first_click(c.df, KEYS, c.bounded).drop("user_id")


@query("inactivity_spans", f"""{CLICKS}, a AS (SELECT *, max(CASE WHEN event_type <> 'session_end' THEN "timestamp" END)
      OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ts FROM clicks WHERE event_type <> 'inactivity')
    SELECT session_id, last_ts + 10000 AS inactivity_start_time, "timestamp" - last_ts - 10000 AS inactivity_duration
    FROM a WHERE "timestamp" - last_ts >= 10000""")
def inactivity_spans(spark, sf):
    c = Clicks(spark, sf)
    return b.inactivity_spans(c.df, KEYS, bounded=c.bounded).drop("user_id")


CART_SQL = f"""
c0 AS (SELECT session_id, "timestamp", event_id, event_type, row_number() OVER ({W}) AS rn FROM clicks
       WHERE event_type IN ('add_to_cart', 'remove_from_cart', 'purchase_click')),
cart AS (SELECT session_id, "timestamp", event_id, rn, CASE event_type WHEN 'add_to_cart' THEN 1 ELSE 0 END AS cart_count
         FROM c0 WHERE rn = 1
         UNION ALL
         SELECT n.session_id, n."timestamp", n.event_id, n.rn, CASE n.event_type WHEN 'add_to_cart' THEN cart.cart_count + 1
                WHEN 'remove_from_cart' THEN greatest(0, cart.cart_count - 1) ELSE 0 END
         FROM cart JOIN c0 n ON n.session_id = cart.session_id AND n.rn = cart.rn + 1)
"""
RCLICKS = "WITH RECURSIVE " + clicks_sql()


@query("cart_state", f"{RCLICKS}, {CART_SQL} SELECT event_id, cart_count FROM cart")
def cart_state(spark, sf):
    c = Clicks(spark, sf)
    return b.cart_state(c.df, KEYS, c.bounded).select("event_id", "cart_count")


@query("cart_abandonment", f"""{RCLICKS}, {CART_SQL}, l AS (SELECT session_id,
      (array_agg(cart_count ORDER BY rn DESC))[1] AS cart_item_count FROM cart GROUP BY 1)
    SELECT session_id, cart_item_count, true AS cart_abandon_flag FROM l WHERE cart_item_count > 0""")
def cart_abandonment(spark, sf):
    c = Clicks(spark, sf)
    return b.cart_abandonment(c.df, KEYS, c.bounded).drop("user_id")


@query("section_revisits", f"""{CLICKS}, r AS (SELECT event_id, p_section AS section, row_number() OVER (
      PARTITION BY session_id, p_section ORDER BY "timestamp", event_id) AS "count" FROM clicks
      WHERE event_type = 'section_enter')
    SELECT * FROM r WHERE "count" > 1""")
def section_revisits(spark, sf):
    c = Clicks(spark, sf)
    return b.section_revisits(c.df, KEYS, bounded=c.bounded).select("event_id", "section", "count")


@query("section_transitions", f"""{CLICKS}, r AS (SELECT event_id, lag(p_section) OVER ({W}) AS "from", p_section AS "to"
      FROM clicks WHERE event_type = 'section_enter')
    SELECT * FROM r WHERE "from" <> "to" """)
def section_transitions(spark, sf):
    c = Clicks(spark, sf)
    return b.section_transitions(c.df, KEYS, bounded=c.bounded).select("event_id", "from", "to")


@query("subsection_dwell", f"""{CLICKS}, s AS (SELECT *,
      sum(CASE WHEN event_type = 'navigation' THEN 1 ELSE 0 END) OVER {UPTO} AS page FROM clicks
      WHERE event_type IN ('subsection_enter', 'subsection_exit', 'navigation')),
    r AS (SELECT event_id, event_type, p_subsection_id AS subsection_id,
      lag(event_type) OVER x AS pt, "timestamp" - lag("timestamp") OVER x AS dwell_ms FROM s
      WINDOW x AS (PARTITION BY session_id, page, p_subsection_id ORDER BY "timestamp", event_id))
    SELECT event_id, subsection_id, dwell_ms FROM r WHERE event_type = 'subsection_exit' AND pt = 'subsection_enter'""")
def subsection_dwell(spark, sf):
    c = Clicks(spark, sf)
    return b.subsection_dwell(c.df, KEYS, bounded=c.bounded).select("event_id", "subsection_id", "dwell_ms")


@query("tab_away", f"""{CLICKS}, r AS (SELECT event_id, event_type, lag(event_type) OVER ({W}) AS pt,
      "timestamp" - lag("timestamp") OVER ({W}) AS d FROM clicks WHERE event_type IN ('tab_exit', 'tab_return'))
    SELECT event_id, CASE WHEN pt = 'tab_exit' THEN d END AS tab_exit_duration_ms FROM r WHERE event_type = 'tab_return'""")
def tab_away(spark, sf):
    c = Clicks(spark, sf)
    return b.tab_away(c.df, KEYS, c.bounded).select("event_id", "tab_exit_duration_ms")


def _depths(c):
    return c.df.where(F.col("event_type").isin("scroll_depth", "scroll_milestone")).withColumn("depth", F.col("p.depth_pct"))


@query("milestones", f"""{CLICKS}, d AS (SELECT session_id, "timestamp", event_id, p_depth_pct AS depth,
      row_number() OVER ({W}) AS rn FROM clicks WHERE event_type IN ('scroll_depth', 'scroll_milestone')),
    m AS (SELECT session_id, milestone, "timestamp", event_id FROM d, (VALUES (25), (50), (75), (100)) AS t(milestone)
      WHERE rn > 1 AND depth >= milestone)
    SELECT session_id, milestone, (array_agg(event_id ORDER BY "timestamp", event_id))[1] AS event_id FROM m GROUP BY 1, 2""")
def milestones(spark, sf):
    c = Clicks(spark, sf)
    return b.milestones(_depths(c), "depth", [25, 50, 75, 100], KEYS).select("session_id", "milestone", "event_id")


@query("direction_changes", f"""{CLICKS}, d0 AS (SELECT session_id, "timestamp", event_id, floor(value * 20) AS y,
      row_number() OVER ({W}) AS rn FROM clicks),
    d1 AS (SELECT *, CASE WHEN y > coalesce(lag(y) OVER ({W}), 0) THEN 'down' ELSE 'up' END AS "to" FROM d0 WHERE rn > 1),
    d2 AS (SELECT event_id, "to", lag("to") OVER ({W}) AS "from" FROM d1)
    SELECT event_id, "from", "to" FROM d2 WHERE "from" <> "to" """)
def direction_changes(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.withColumn("y", F.floor(F.col("value") * 20).cast("double"))
    return b.direction_changes(rows, "y", KEYS, bounded=c.bounded).select("event_id", "from", "to")


@query("debounce_last", f"""{CLICKS}, d AS (SELECT event_id, "timestamp" AS t, lead("timestamp") OVER (
      PARTITION BY session_id, p_input_name ORDER BY "timestamp", event_id) AS nt FROM clicks WHERE k % 20 > 0)
    SELECT event_id FROM d WHERE nt IS NULL OR nt - t >= 3600000""")
def debounce_last(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.withColumns({"field": F.col("p.input_name"), "length": F.col("k") % 20})
    return b.debounce_last(rows, "field", "length", KEYS, wait_ms=3_600_000, bounded=c.bounded).select("event_id")


@query("nav_paths", f"""{CLICKS} SELECT event_id, row_number() OVER ({W}) AS page_depth,
    lag(pathname) OVER ({W}) AS previous FROM clicks WHERE event_type = 'navigation'""")
def nav_paths(spark, sf):
    c = Clicks(spark, sf)
    return b.nav_paths(c.df, KEYS, c.bounded).select("event_id", "page_depth", "previous")


@query("session_paths", f"""{CLICKS}, n AS (SELECT session_id, pathname, row_number() OVER ({W}) AS pos FROM clicks
      WHERE event_type = 'navigation')
    SELECT session_id, (pos - 1) // 4 AS part, string_agg(pathname, ' ' ORDER BY pos) AS path, count(*) AS n
    FROM n GROUP BY 1, 2""")
def session_paths(spark, sf):
    from pathloom.operators.sequences import in_parts

    c = Clicks(spark, sf)
    paths = b.nav_paths(c.df, KEYS, c.bounded).select("session_id", F.col("page_depth").alias("pos"), "pathname")
    parts = in_parts(paths, ["session_id"], "pathname", rows=4)
    return parts.select("session_id", "part", F.array_join("values", " ").alias("path"), F.size("values").alias("n"))


@query("page_dwell", f"""{CLICKS}, v AS (SELECT *, sum(CASE WHEN event_type = 'navigation' THEN 1 ELSE 0 END) OVER {UPTO}
      AS visit FROM clicks),
    p AS (SELECT session_id, visit, min("timestamp") AS enter_ts, max("timestamp") AS last_ts,
      (array_agg(pathname ORDER BY "timestamp", event_id))[1] AS pathname FROM v GROUP BY 1, 2)
    SELECT session_id, visit, pathname, coalesce(lead(enter_ts) OVER (PARTITION BY session_id ORDER BY visit), last_ts)
      - enter_ts AS page_dwell_time FROM p""")
def page_dwell(spark, sf):
    c = Clicks(spark, sf)
    return b.page_dwell(c.df, KEYS, c.bounded).select("session_id", "visit", "pathname", "page_dwell_time")


_PASSIVE = ", ".join(f"'{e}'" for e in b.PASSIVE)


@query("exit_records", f"""{CLICKS} SELECT session_id, (array_agg(pathname ORDER BY "timestamp" DESC, event_id DESC))[1] AS exit_page,
    max("timestamp") AS last_event_time, count(*) FILTER (event_type = 'navigation') AS page_depth,
    count(*) FILTER (event_type = 'navigation') <= 1 AND count(*) FILTER (event_type NOT IN ({_PASSIVE})) = 0 AS bounce_flag,
    (array_agg(p_position ORDER BY "timestamp" DESC, event_id DESC) FILTER (p_position IS NOT NULL))[1] AS last_scroll_y
    FROM clicks GROUP BY 1""")
def exit_records(spark, sf):
    return b.exit_records(Clicks(spark, sf).df, KEYS).drop("user_id")


@query("bounce_flags", f"""{CLICKS} SELECT session_id, count(*) FILTER (event_type = 'navigation') <= 1
    AND count(*) FILTER (event_type NOT IN ({_PASSIVE})) = 0 AS bounce_flag FROM clicks GROUP BY 1""")
def bounce_flags(spark, sf):
    return b.bounce_flags(Clicks(spark, sf).df, KEYS).drop("user_id")


@query("option_changes", f"""{CLICKS}, o AS (SELECT session_id, "timestamp", event_id, p_option_name, CASE WHEN p_option_value <> lag(p_option_value) OVER (
      PARTITION BY session_id, p_option_name ORDER BY "timestamp", event_id) THEN 1 ELSE 0 END AS c FROM clicks
      WHERE event_type IN ('option_select', 'option_change')),
    s AS (SELECT event_id, c, sum(c) OVER (PARTITION BY session_id, p_option_name ORDER BY "timestamp", event_id
      ROWS UNBOUNDED PRECEDING) AS change_count FROM o)
    SELECT event_id, change_count FROM s WHERE c = 1""")
def option_changes(spark, sf):
    c = Clicks(spark, sf)
    return b.option_changes(c.df, KEYS, bounded=c.bounded).select("event_id", "change_count")


@query("running_counters", f"""{CLICKS} SELECT event_id, row_number() OVER (PARTITION BY session_id, event_type
    ORDER BY "timestamp", event_id) AS nth FROM clicks WHERE event_type IN ('click', 'tab_exit')""")
def running_counters(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.where(F.col("event_type").isin("click", "tab_exit"))
    return b.nth(rows, ["event_type"], "nth", KEYS, c.bounded).select("event_id", "nth")


@query("refocus_counts", f"""{CLICKS} SELECT event_id, row_number() OVER (PARTITION BY session_id, p_input_name
    ORDER BY "timestamp", event_id) - 1 AS field_refocus_count FROM clicks WHERE event_type = 'field_focus'""")
def refocus_counts(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.where(F.col("event_type") == "field_focus").withColumn("field", F.col("p.input_name"))
    return b.nth(rows, ["field"], "nth", KEYS, c.bounded).select("event_id", (F.col("nth") - 1).alias("field_refocus_count"))


@query("motion_summary", f"""{CLICKS}, m0 AS (SELECT session_id, "timestamp", event_id, p_x AS x, value AS y FROM clicks),
    m1 AS (SELECT *, x - lag(x) OVER ({W}) AS dx, y - lag(y) OVER ({W}) AS dy FROM m0),
    m2 AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist, CASE WHEN dx IS NOT NULL THEN sign(dx) * 10 + sign(dy) END AS dir FROM m1),
    m3 AS (SELECT *, lag(dir) OVER ({W}) AS pd FROM m2),
    m4 AS (SELECT session_id, "timestamp" - "timestamp" % 3600000 AS window_start, CAST(round(sum(dist)) AS BIGINT) AS distance_px,
      count(*) FILTER (pd <> dir) AS jitter_count FROM m3 GROUP BY 1, 2)
    SELECT * FROM m4 WHERE distance_px > 0""")
def motion_summary(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.withColumns({"x": F.col("p.x"), "y": F.col("value")})
    return b.motion_summary(rows, KEYS, 3_600_000, c.bounded).drop("user_id")


# the generated events lie hours apart, so the folds run with proportionally longer times
_HOUR = 3_600_000


@query("rage_clicks", f"""{RCLICKS}, r0 AS (SELECT session_id, "timestamp" AS t, event_id, p_x AS x, value AS y,
      row_number() OVER ({W}) AS rn FROM clicks),
    r(session_id, rn, fired, recent, event_id, hits) AS (
      SELECT session_id, rn, CAST(NULL AS BIGINT), [{{'t': t, 'x': x, 'y': y}}], event_id, 0 FROM r0 WHERE rn = 1
      UNION ALL
      SELECT session_id, rn, CASE WHEN hot THEN fired WHEN len(near) + 1 >= 3 THEN t ELSE fired END,
        CASE WHEN hot OR len(near) + 1 >= 3 THEN list_filter(near, lambda c: false) ELSE list_append(near, {{'t': t, 'x': x, 'y': y}}) END,
        event_id, CASE WHEN NOT hot AND len(near) + 1 >= 3 THEN len(near) + 1 ELSE 0 END
      FROM (SELECT n.session_id, n.rn, r.fired, n.event_id, n.t, n.x, n.y, coalesce(n.t - r.fired < {24 * _HOUR}, false) AS hot,
        CASE WHEN len(list_filter(list_filter(r.recent, lambda c: n.t - c.t < {12 * _HOUR}),
                 lambda c: abs(c.x - n.x) > 400 OR abs(c.y - n.y) > 400)) > 0 THEN list_filter(r.recent, lambda c: false)
             ELSE list_filter(r.recent, lambda c: n.t - c.t < {12 * _HOUR}) END AS near
        FROM r JOIN r0 n ON n.session_id = r.session_id AND n.rn = r.rn + 1))
    SELECT event_id, hits AS click_count FROM r WHERE hits > 0""")
def rage_clicks(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.withColumns({"x": F.col("p.x"), "y": F.col("value")})
    out = b.rage_clicks(rows, KEYS, 12 * _HOUR, 400, 3, 24 * _HOUR, c.bounded)
    return out.select("event_id", "click_count")


@query("thin_by_delta", f"""{RCLICKS}, r0 AS (SELECT session_id, event_id, p_depth_pct AS v, row_number() OVER ({W}) AS rn
      FROM clicks WHERE p_depth_pct IS NOT NULL),
    r AS (SELECT session_id, rn, event_id, v AS base, false AS kept FROM r0 WHERE rn = 1
      UNION ALL SELECT n.session_id, n.rn, n.event_id, CASE WHEN abs(n.v - r.base) >= 5 THEN n.v ELSE r.base END,
        abs(n.v - r.base) >= 5 FROM r JOIN r0 n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
    SELECT event_id, base AS depth FROM r WHERE kept""")
def thin_by_delta(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.withColumn("depth", F.col("p.depth_pct"))
    return b.thin_by_delta(rows, "depth", KEYS, bounded=c.bounded).select("event_id", "depth")


@query("throttled_speed", f"""{RCLICKS}, r0 AS (SELECT session_id, event_id, "timestamp" AS t, floor(value * 20) AS y,
      row_number() OVER ({W}) AS rn FROM clicks),
    r AS (SELECT session_id, rn, event_id, t AS bt, y AS yb, CAST(NULL AS DOUBLE) AS dy, CAST(NULL AS BIGINT) AS dt FROM r0 WHERE rn = 1
      UNION ALL SELECT n.session_id, n.rn, n.event_id, CASE WHEN n.t - r.bt >= {6 * _HOUR} THEN n.t ELSE r.bt END,
        CASE WHEN n.t - r.bt >= {6 * _HOUR} THEN n.y ELSE r.yb END,
        CASE WHEN n.t - r.bt >= {6 * _HOUR} THEN abs(n.y - r.yb) END, CASE WHEN n.t - r.bt >= {6 * _HOUR} THEN n.t - r.bt END
        FROM r JOIN r0 n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
    SELECT event_id, dy AS distance_px, dt AS duration_ms FROM r WHERE dy >= 50""")
def throttled_speed(spark, sf):
    c = Clicks(spark, sf)
    rows = c.df.withColumn("y", F.floor(F.col("value") * 20).cast("double"))
    out = b.throttled_speed(rows, "y", KEYS, 6 * _HOUR, bounded=c.bounded)
    return out.select("event_id", "distance_px", "duration_ms")


@query("suppress_repeats", f"""{RCLICKS}, r0 AS (SELECT session_id, event_id, "timestamp" AS t, pathname AS p,
      row_number() OVER ({W}) AS rn FROM clicks),
    r AS (SELECT session_id, rn, event_id, t AS bt, p AS bp, true AS kept FROM r0 WHERE rn = 1
      UNION ALL SELECT n.session_id, n.rn, n.event_id, CASE WHEN n.p = r.bp AND n.t - r.bt < {8 * _HOUR} THEN r.bt ELSE n.t END,
        n.p, NOT (n.p = r.bp AND n.t - r.bt < {8 * _HOUR}) FROM r JOIN r0 n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
    SELECT event_id FROM r WHERE kept""")
def suppress_repeats(spark, sf):
    c = Clicks(spark, sf)
    return b.suppress_repeats(c.df, KEYS, 8 * _HOUR, c.bounded).select("event_id")


# the same folds on the envelope's own string ids, at their default thresholds: hours count as milliseconds
_QUICK = "SELECT session_id, user_id, event_type, \"timestamp\" // 40000 AS t, concat('evt-', md5(CAST(event_id AS VARCHAR))) AS id, pathname AS p, p_x AS x, value AS y, p_depth_pct AS v FROM clicks"


def _quick(spark, sf):
    c = Clicks(spark, sf)
    return c, c.df.drop("event_seq").withColumns({
        "timestamp": F.expr("timestamp div 40000"), "event_id": F.concat(F.lit("evt-"), F.md5(F.col("event_id").cast("string"))),
        "x": F.col("p.x"), "y": F.col("value"),
    })


@query("suppress_repeats_defaults", f"""{RCLICKS}, q AS ({_QUICK}), r0 AS (SELECT session_id, id, t, p, row_number() OVER (PARTITION BY session_id ORDER BY t, id) AS rn FROM q),
    r AS (SELECT session_id, rn, id, t AS bt, p AS bp, true AS kept FROM r0 WHERE rn = 1
      UNION ALL SELECT n.session_id, n.rn, n.id, CASE WHEN n.p = r.bp AND n.t - r.bt < 100 THEN r.bt ELSE n.t END,
        n.p, NOT (n.p = r.bp AND n.t - r.bt < 100) FROM r JOIN r0 n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
    SELECT id AS event_id FROM r WHERE kept""")
def suppress_repeats_defaults(spark, sf):
    c, rows = _quick(spark, sf)
    return b.suppress_repeats(rows, KEYS, bounded=c.bounded).select("event_id")


@query("throttled_speed_defaults", f"""{RCLICKS}, q AS ({_QUICK}), r0 AS (SELECT session_id, id, t, y, row_number() OVER (PARTITION BY session_id ORDER BY t, id) AS rn FROM q),
    r AS (SELECT session_id, rn, id, t AS bt, y AS yb, CAST(NULL AS DOUBLE) AS dy, CAST(NULL AS BIGINT) AS dt FROM r0 WHERE rn = 1
      UNION ALL SELECT n.session_id, n.rn, n.id, CASE WHEN n.t - r.bt >= 1000 THEN n.t ELSE r.bt END, CASE WHEN n.t - r.bt >= 1000 THEN n.y ELSE r.yb END,
        CASE WHEN n.t - r.bt >= 1000 THEN abs(n.y - r.yb) END, CASE WHEN n.t - r.bt >= 1000 THEN n.t - r.bt END
        FROM r JOIN r0 n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
    SELECT id AS event_id, round(dy, 6) AS distance_px, dt AS duration_ms FROM r WHERE dy >= 50""")
def throttled_speed_defaults(spark, sf):
    c, rows = _quick(spark, sf)
    out = b.throttled_speed(rows, "y", KEYS, bounded=c.bounded)
    return out.select("event_id", F.round("distance_px", 6).alias("distance_px"), "duration_ms")


@query("thin_by_delta_defaults", f"""{RCLICKS}, q AS ({_QUICK}), r0 AS (SELECT session_id, id, v, row_number() OVER (PARTITION BY session_id ORDER BY t, id) AS rn FROM q WHERE v IS NOT NULL),
    r AS (SELECT session_id, rn, id, v AS base, false AS kept FROM r0 WHERE rn = 1
      UNION ALL SELECT n.session_id, n.rn, n.id, CASE WHEN abs(n.v - r.base) >= 5 THEN n.v ELSE r.base END,
        abs(n.v - r.base) >= 5 FROM r JOIN r0 n ON n.session_id = r.session_id AND n.rn = r.rn + 1)
    SELECT id AS event_id, base AS depth FROM r WHERE kept""")
def thin_by_delta_defaults(spark, sf):
    c, rows = _quick(spark, sf)
    return b.thin_by_delta(rows.withColumn("depth", F.col("p.depth_pct")), "depth", KEYS, bounded=c.bounded).select("event_id", "depth")


# events of one hour share a time; the client's numbering, a text, orders them, then the id
_TIES = {
    "t": "epoch_ms - epoch_ms % 3600000",
    "seq": "CASE WHEN event_id % 50 = 0 THEN 'x' WHEN event_id % 41 = 0 THEN NULL ELSE CAST(event_id % 97 AS VARCHAR(9)) END",
    "id": "md5(CAST(event_id AS VARCHAR(20)))",
}


@query("event_order", f"""WITH e AS (SELECT user_id, {", ".join(f"{q} AS {n}" for n, q in _TIES.items())} FROM (SELECT *, epoch_us(ts) // 1000 AS epoch_ms FROM events))
    SELECT user_id, id AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, coalesce(try_cast(seq AS DOUBLE), 0), id) AS event_seq FROM e""")
def event_order(spark, sf):
    raw = table(spark, sf, "events").withColumn("epoch_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    e = raw.select("user_id", *(F.expr(q).alias(n) for n, q in _TIES.items())).withColumnsRenamed({"t": "timestamp", "seq": "event_seq", "id": "event_id"})
    return ss.event_seq(e, ["user_id"]).select("user_id", "event_id", "event_seq")


INTENTS = {"add_to_cart": ["purchase_click", "session_end"], "search_use": ["product_click", "tab_exit", "inactivity"]}


@query("resolve_intents", f"""{CLICKS}, i0 AS (SELECT *, CASE WHEN event_type IN ('add_to_cart', 'purchase_click', 'session_end')
      THEN 'add_to_cart' ELSE 'search_use' END AS intent FROM clicks WHERE event_type IN ('add_to_cart', 'purchase_click',
      'session_end', 'search_use', 'product_click', 'tab_exit', 'inactivity')),
    i1 AS (SELECT *, lead(event_type) OVER x AS nt, lead("timestamp") OVER x AS nts FROM i0
      WINDOW x AS (PARTITION BY session_id, intent ORDER BY "timestamp", event_id))
    SELECT event_id, intent, CASE WHEN nt <> intent AND nts - "timestamp" < {12 * _HOUR} THEN nt END AS outcome,
      CASE WHEN nt <> intent AND nts - "timestamp" < {12 * _HOUR} THEN nts - "timestamp" END AS wait_ms
    FROM i1 WHERE event_type = intent""")
def resolve_intents(spark, sf):
    c = Clicks(spark, sf)
    out = b.resolve_intents(c.df, INTENTS, KEYS, 12 * _HOUR, c.bounded)
    return out.select("event_id", "intent", "outcome", "wait_ms")


@query("conversation_turns", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS event_seq,
    coalesce(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS inter_event_gap FROM conversations""")
def conversation_turns(spark, sf):
    from pathloom.operators.sessions import event_seq, inter_event_gap

    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").alias("timestamp"), F.col("turn").alias("event_id"))
    out = inter_event_gap(event_seq(rows, ["conv_id"]), ["conv_id"])
    return out.select("conv_id", "turn", "event_seq", "inter_event_gap")
