"""Registered queries: sessions while they are open, from a stream with timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.plans.fixtures import DAY_MS, _payload, raw_clicks
from pathloom.plans.queries_behaviour import INTENTS, RCLICKS, UPTO, W
from pathloom.plans.queries_streaming import CLICKS, HOUR, collected, event_stream, finish
from pathloom.plans.registry import CHECKS, query
from pathloom.session import work_path
from pathloom.streaming import ingest, intents, late, live

#: What the watermark has passed when the stream has been read.
_SEEN = '(SELECT max("timestamp") - 600000 FROM clicks)'


def live_kinds(spark, sf, *kinds):
    # positions of the generated events are x and value, and they lie hours apart
    rows = event_stream(spark, sf).withColumn("p", _payload())
    rows = rows.withColumn("p", F.col("p").withField("click_position", F.struct(F.col("p.x").alias("x"), F.col("value").alias("y"))))
    events = live.live_rows(rows)
    out = live.live_sessions(events, ttl_ms=DAY_MS, window_ms=12 * HOUR, radius=400, cooldown_ms=24 * HOUR, rage_types=None)
    return collected(spark, out.where(F.col("kind").isin(*kinds)), "live")


@query("live_behaviour", f"""{RCLICKS}, seen AS (SELECT event_id FROM clicks WHERE "timestamp" <= {_SEEN}),
    silent AS (SELECT *, max(CASE WHEN event_type <> 'session_end' THEN "timestamp" END)
      OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heard FROM clicks WHERE event_type <> 'inactivity'),
    v AS (SELECT *, sum(CASE WHEN event_type IN ('navigation', 'session_start') THEN 1 ELSE 0 END) OVER {UPTO} AS visit FROM clicks),
    firsts AS (SELECT c.event_id, c.visit, c."timestamp" - (SELECT min("timestamp") FROM v e WHERE e.session_id = c.session_id AND e.visit = c.visit) AS d
      FROM v c WHERE event_type = 'click' AND visit > 0
      QUALIFY row_number() OVER (PARTITION BY session_id, visit ORDER BY "timestamp", event_id) = 1),
    happened AS (
      SELECT 'cart' AS kind, event_id, NULL AS name, cart_count AS number, NULL AS duration_ms FROM ({CHECKS["cart_state"]})
      UNION ALL SELECT 'rage_click', event_id, NULL, click_count, NULL FROM ({CHECKS["rage_clicks"]})
      UNION ALL SELECT 'revisit', event_id, section, "count", NULL FROM ({CHECKS["section_revisits"]})
      UNION ALL SELECT 'option', q.event_id, p_option_name, change_count, NULL FROM ({CHECKS["option_changes"]}) q JOIN clicks USING (event_id)
      UNION ALL SELECT 'first_click', event_id, NULL, visit, d FROM firsts
      UNION ALL SELECT 'inactivity', event_id, NULL, NULL, "timestamp" - heard - 10000 FROM silent WHERE "timestamp" - heard >= 10000)
    SELECT kind, event_id, name, CAST(number AS BIGINT) AS number, CAST(duration_ms AS BIGINT) AS duration_ms FROM happened SEMI JOIN seen USING (event_id)""")
def live_behaviour(spark, sf):
    """Carts, rage clicks, first clicks, revisits, options and silences with their event, as far as the watermark has come."""
    out = live_kinds(spark, sf, "cart", "rage_click", "revisit", "option", "first_click", "inactivity")
    return out.select("kind", "event_id", "name", "number", "duration_ms")


@query("live_idle", f"""{CLICKS}, heard AS (SELECT user_id, "timestamp" + 10000 AS idle_at, lead("timestamp") OVER ({W}) AS next_ts
      FROM clicks WHERE event_type NOT IN ('inactivity', 'session_end'))
    SELECT user_id, idle_at FROM heard WHERE (next_ts IS NULL OR next_ts >= idle_at) AND idle_at <= {_SEEN}""")
def live_idle(spark, sf):
    """When ten seconds of silence are over; no further event is needed."""
    return live_kinds(spark, sf, "idle").select("user_id", F.col("timestamp").alias("idle_at"))


_OVER = f"""over_ AS (SELECT session_id, min("timestamp") AS started_at FROM clicks GROUP BY 1 HAVING max("timestamp") + {DAY_MS} <= {_SEEN})"""


@query("live_exit_records", f"""{CLICKS}, {_OVER}, x AS ({CHECKS["exit_records"]}),
    d AS (SELECT session_id, page_dwell_time FROM ({CHECKS["page_dwell"]}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY visit DESC) = 1),
    n AS (SELECT user_id, session_id, count(*) AS events, (array_agg(utm_source ORDER BY "timestamp", event_id))[1] AS utm_source FROM clicks GROUP BY 1, 2)
    SELECT user_id, started_at, exit_page, last_event_time, page_depth, bounce_flag, last_scroll_y, page_dwell_time, events, utm_source, 'timeout' AS exit_reason
    FROM over_ JOIN x USING (session_id) JOIN d USING (session_id) JOIN n USING (session_id)""")
def live_exit_records(spark, sf):
    """What is known of a session when its timeout fires."""
    return live_kinds(spark, sf, "session_end").select(
        "user_id", "started_at", F.col("name").alias("exit_page"), F.col("timestamp").alias("last_event_time"), F.col("depth").alias("page_depth"),
        F.col("bounce").alias("bounce_flag"), F.col("scroll_y").alias("last_scroll_y"), F.col("duration_ms").alias("page_dwell_time"),
        F.col("number").alias("events"), F.col("source").alias("utm_source"), "exit_reason",
    )


@query("live_pages", f"""{CLICKS}, v AS (SELECT *, sum(CASE WHEN event_type = 'navigation' THEN 1 ELSE 0 END) OVER {UPTO} AS visit FROM clicks),
    p AS (SELECT user_id, session_id, visit, min("timestamp") AS enter_ts, max("timestamp") AS last_ts,
      (array_agg(pathname ORDER BY "timestamp", event_id))[1] AS pathname FROM v GROUP BY 1, 2, 3),
    q AS (SELECT *, lead(enter_ts) OVER (PARTITION BY session_id ORDER BY visit) AS next_ts FROM p), {_OVER}
    SELECT user_id, visit, pathname, coalesce(next_ts, last_ts) AS left_at, coalesce(next_ts, last_ts) - enter_ts AS page_dwell_time
    FROM q LEFT JOIN over_ o USING (session_id) WHERE next_ts <= {_SEEN} OR next_ts IS NULL AND o.session_id IS NOT NULL""")
def live_pages(spark, sf):
    """Pages as they are left, or with the end of their session."""
    return live_kinds(spark, sf, "page").select(
        "user_id", F.col("number").alias("visit"), F.col("name").alias("pathname"), F.col("timestamp").alias("left_at"),
        F.col("duration_ms").alias("page_dwell_time"),
    )


@query("live_motion", f"""{CLICKS}, m AS ({CHECKS["motion_summary"]}), u AS (SELECT session_id, any_value(user_id) AS user_id FROM clicks GROUP BY 1)
    SELECT user_id, window_start, distance_px, jitter_count FROM m JOIN u USING (session_id)
    WHERE window_start + 3600000 <= (SELECT max("timestamp") - 10000 FROM clicks)""")
def live_motion(spark, sf):
    """Distance and flips from raw positions; windows of an hour, since the generated events lie that far apart."""
    rows = event_stream(spark, sf).withColumn("p", _payload())
    rows = rows.select("user_id", "event_time", "timestamp", "event_id", F.col("p.x").alias("x"), F.col("value").cast("double").alias("y"))
    return collected(spark, live.live_motion(rows, window_ms=HOUR, ttl_ms=DAY_MS), "motion")


@query("intent_outcomes", f"""{CLICKS} SELECT q.event_id, q.intent, q.outcome, q.wait_ms FROM ({CHECKS["resolve_intents"]}) q JOIN clicks USING (event_id)
    WHERE "timestamp" + {12 * HOUR + 601_000} < (SELECT max("timestamp") FROM clicks)""")
def intent_outcomes(spark, sf):
    """Two streams joined within twelve hours; intents whose bound the watermark has passed."""
    pairs = collected(spark, intents.intent_pairs(event_stream(spark, sf), 12 * HOUR, INTENTS), "pairs")
    newest = raw_clicks(spark, sf).agg(F.max("timestamp").alias("newest"))
    done = intents.resolved(pairs).join(F.broadcast(newest), F.col("timestamp") + 12 * HOUR + 601_000 < F.col("newest"))  # one row
    return done.select("event_id", "intent", "outcome", "wait_ms")


def _delivered(spark, sf, *parts):
    """Events as files, one part after the other; ``parts`` are conditions. The second value adds the files of the next part."""
    path, rest = work_path(spark, "delivered"), iter(parts)

    def deliver():
        raw_clicks(spark, sf).where(next(rest)).write.mode("append").parquet(path)

    return path, deliver


@query("late_sessions", f"""{CLICKS} SELECT user_id, count(*) AS events, min("timestamp") AS started, max("timestamp") AS ended,
    (array_agg(utm_source ORDER BY "timestamp", event_id))[1] AS utm_source, (array_agg(pathname ORDER BY "timestamp" DESC, event_id DESC))[1] AS exit_page,
    count(*) FILTER (event_type = 'navigation') AS page_depth FROM clicks GROUP BY user_id, session_id""")
def late_sessions(spark, sf):
    """A seventh of the events arrives after all others; merged in, the stored sessions are those of all events."""
    path, deliver = _delivered(spark, sf, "event_id % 7 <> 0", "event_id % 7 = 0")
    out, progress = work_path(spark, "split"), work_path(spark, "split-progress")
    for _ in range(2):
        deliver()
        stream = spark.readStream.schema(raw_clicks(spark, sf).schema).parquet(path)
        finish(late.split(stream, out, progress))
    rows = late.stored(spark, out)
    sessions = late.merge(late.as_sessions(rows.where(~F.col("late"))), ttl_ms=DAY_MS)
    whole = late.correct(sessions, rows.where("late"), ttl_ms=DAY_MS)
    return whole.select("user_id", "events", "started", "ended", "first.utm_source", F.col("last.pathname").alias("exit_page"), "page_depth")


@query("late_events", f"""{CLICKS} SELECT event_id, event_id % 7 = 0 AND "timestamp" <= (SELECT max("timestamp") - 600000 FROM clicks WHERE event_id % 7 <> 0) AS late FROM clicks""")
def late_events(spark, sf):
    """Rows that come after the watermark has passed them are marked and kept."""
    path, deliver = _delivered(spark, sf, "event_id % 7 <> 0", "event_id % 7 = 0")
    out, progress = work_path(spark, "split"), work_path(spark, "split-progress")
    for _ in range(2):
        deliver()
        finish(late.split(spark.readStream.schema(raw_clicks(spark, sf).schema).parquet(path), out, progress))
    return late.stored(spark, out).select("event_id", "late")


@query("follow_events", """SELECT event_id, event_id % 2 AS run FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'""")
def follow_events(spark, sf):
    """Two runs over what has arrived by then; the second one resumes and reads only what is new."""
    path, deliver = _delivered(spark, sf, "event_id % 2 = 0", "event_id % 2 = 1")
    out, progress = work_path(spark, "followed"), work_path(spark, "followed-progress")
    schema, batches = raw_clicks(spark, sf).schema, []
    for _ in range(2):
        deliver()
        finish(ingest.follow(spark, path, schema, out, progress, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")))
        batches.append(spark.read.parquet(out).agg(F.max("batch")).first()[0])
    # a run may take several batches
    return spark.read.parquet(out).select("event_id", (F.col("batch") > batches[0]).cast("long").alias("run"))
