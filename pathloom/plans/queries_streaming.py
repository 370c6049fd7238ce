"""Registered queries: the same tables read as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions.vectors import as_doubles
from pathloom.operators import behaviour as b
from pathloom.operators.clusters import centroids
from pathloom.plans.fixtures import DAY_MS, ENVELOPE_SQL, PAYLOAD_SQL, clicks_sql, payload_sql, raw_clicks, stored_clicks, table
from pathloom.plans.queries_clusters import CENTROIDS, SIMS, vectors_of
from pathloom.plans.queries_behaviour import INTENTS
from pathloom.plans.registry import CHECKS, query
from pathloom.session import cut, work_path
from pathloom.streaming import ingest, kpis, sessions as ss

CLICKS = "WITH " + clicks_sql()
HOUR = 3_600_000


def table_stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files."""
    # only a path with a pattern in it may name a file as well as a folder
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{{{name}}}.parquet")


def event_stream(spark, sf):
    """The events as a stream of envelope rows."""
    raw = table_stream(spark, sf, "events")
    e = raw.select(
        "event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "event_type", "value",
        F.from_json("props", "k INT")["k"].alias("k"),
    )
    e = e.select("*", *(F.expr(s).alias(f"__{n}") for n, s in ENVELOPE_SQL.items())).drop("event_type")
    e = e.withColumnsRenamed({f"__{n}": n for n in ENVELOPE_SQL})
    return e.withColumn("event_time", ingest.event_time(F.col("timestamp")))


def finish(query):
    """Wait for a run over all available data."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def collected(spark, stream, name):
    path = work_path(spark, name)
    finish(ingest.append(stream, path, work_path(spark, f"{name}-progress")))
    return spark.read.parquet(path)


@query("ingest_stream", f"""{CLICKS} SELECT event_id, event_type, origin FROM clicks
    UNION ALL SELECT NULL, 'anonymous', origin FROM (SELECT DISTINCT origin FROM clicks), (SELECT unnest(range(4)))""")
def ingest_stream(spark, sf):
    """Every event is delivered twice, in batches as a collector sends them; it is stored once.

    Each site also sends texts that are no batch, events without a type, and events without an id: the first two are dropped, the
    last ones all stay, two of each delivery.
    """
    path = work_path(spark, "deliveries")
    e = raw_clicks(spark, sf).select(
        F.col("event_id").alias("n"), F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type", "timestamp").alias("e"), "origin"
    )
    for folder, size in (("a", 30), ("b", 7)):
        lines = e.groupBy("origin", F.floor(F.col("n") / size).alias("batch")).agg(F.to_json(F.struct(F.collect_list("e").alias("events"))).alias("body"))
        nameless = '{"event_type": "anonymous", "timestamp": 1704067200000, "event_id": null}'
        odd = ["no batch", "", "[1, 2]", '{"events": [{"event_id": "x"}]}', '{"events": 7}', f'{{"events": [{nameless}, {nameless}]}}']
        sites = e.select("origin").distinct().select("origin", F.explode(F.array(*map(F.lit, odd))).alias("body"))
        lines.select("origin", "body").unionByName(sites).write.parquet(f"{path}/{folder}")
    raw = spark.readStream.schema("origin string, body string").option("recursiveFileLookup", True).parquet(path)
    accepted = ingest.accept(raw.withColumnRenamed("body", "value"), F.col("origin"), F.current_timestamp())
    timed = accepted.withColumn("event_time", ingest.event_time(F.col("timestamp")))
    out = collected(spark, ingest.once(timed, "60 days"), "stored")
    return out.select(F.col("event_id").cast("long").alias("event_id"), "event_type", "origin")


_CLOSED = f"""{CLICKS}, s AS (SELECT user_id, session_id, count(*) AS events, min("timestamp") AS started, max("timestamp") AS ended,
    (array_agg(utm_source ORDER BY "timestamp", event_id))[1] AS utm_source, (array_agg(pathname ORDER BY "timestamp" DESC, event_id DESC))[1] AS exit_page,
    count(*) FILTER (event_type = 'navigation') AS page_depth FROM clicks GROUP BY 1, 2),
    closed AS (SELECT * FROM s WHERE ended + {DAY_MS} - 1 <= (SELECT max("timestamp") FROM clicks) - 600000)"""


@query("stream_sessions", f"{_CLOSED} SELECT user_id, events, started, ended, utm_source, exit_page, page_depth FROM closed")
def stream_sessions(spark, sf):
    out = collected(spark, ss.stream_sessions(event_stream(spark, sf), ttl_ms=DAY_MS), "sessions")
    return out.select(
        "user_id", "events", F.unix_millis("started_at").alias("started"), F.unix_millis("ended_at").alias("ended"),
        "utm_source", "exit_page", "page_depth",
    )


@query("stream_carts", f"""WITH RECURSIVE {_CLOSED[5:]}, c0 AS (SELECT session_id, event_type, event_id, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", event_id) AS rn
      FROM clicks WHERE event_type IN ('add_to_cart', 'remove_from_cart', 'purchase_click') AND session_id IN (SELECT session_id FROM closed)),
    cart AS (SELECT session_id, event_id, rn, CASE event_type WHEN 'add_to_cart' THEN 1 ELSE 0 END AS cart_count FROM c0 WHERE rn = 1
      UNION ALL SELECT n.session_id, n.event_id, n.rn, CASE n.event_type WHEN 'add_to_cart' THEN cart.cart_count + 1 WHEN 'remove_from_cart'
        THEN greatest(0, cart.cart_count - 1) ELSE 0 END FROM cart JOIN c0 n ON n.session_id = cart.session_id AND n.rn = cart.rn + 1)
    SELECT event_id, cart_count FROM cart""")
def stream_carts(spark, sf):
    """Cart states, derived as the sessions close."""
    return _derived(spark, sf, "carts", b.cart_state, lambda e: e.drop("p")).select("event_id", "cart_count")


def _derived(spark, sf, name, derive, read=lambda e: e):
    """What a batch operator makes of the sessions as they close.

    ``read`` picks what it needs of the stored events before they meet their sessions: a struct that is opened after a join is built whole.
    """
    path = work_path(spark, name)

    def stored():
        return read(stored_clicks(spark, sf).withColumn("event_time", ingest.event_time(F.col("timestamp"))))

    closing = ss.session_spans(event_stream(spark, sf), ttl_ms=DAY_MS)
    finish(ss.on_close(closing, stored, derive, path, work_path(spark, f"{name}-progress")))
    return spark.read.parquet(path)


def _closed_only(batch: str, columns: str) -> str:
    """Rows of a batch query that belong to events of closed sessions."""
    return f"""{_CLOSED}, own AS (SELECT event_id FROM clicks WHERE session_id IN (SELECT session_id FROM closed))
    SELECT {columns} FROM ({CHECKS[batch]}) q WHERE q.event_id IN (SELECT event_id FROM own)"""


@query("stream_rage_clicks", _closed_only("rage_clicks", "event_id, click_count"))
def stream_rage_clicks(spark, sf):
    def read(events):
        return events.select("event_id", "user_id", "timestamp", "event_time", F.col("p.x").alias("x"), F.col("value").alias("y"))

    def derive(rows):
        return b.rage_clicks(rows, ["session_id"], 12 * HOUR, 400, 3, 24 * HOUR)

    return _derived(spark, sf, "rage", derive, read).select("event_id", "click_count")


@query("stream_revisits", _closed_only("section_revisits", 'event_id, section, "count"'))
def stream_revisits(spark, sf):
    return _derived(spark, sf, "revisits", b.section_revisits).select("event_id", "section", "count")


@query("stream_options", _closed_only("option_changes", "event_id, change_count"))
def stream_options(spark, sf):
    return _derived(spark, sf, "options", b.option_changes).select("event_id", "change_count")


@query("stream_tab_away", _closed_only("tab_away", "event_id, tab_exit_duration_ms"))
def stream_tab_away(spark, sf):
    return _derived(spark, sf, "tabs", b.tab_away).select("event_id", "tab_exit_duration_ms")


@query("stream_intents", _closed_only("resolve_intents", "event_id, intent, outcome, wait_ms"))
def stream_intents(spark, sf):
    """Each intent with its outcome, once its session is over."""
    out = _derived(spark, sf, "intents", lambda rows: b.resolve_intents(rows, INTENTS, ["session_id"], 12 * HOUR))
    return out.select("event_id", "intent", "outcome", "wait_ms")


@query("stream_first_clicks", f"""{_CLOSED} SELECT q.* REPLACE (CAST(split_part(q.session_id, '-', 1) AS BIGINT) AS session_id) FROM ({CHECKS["time_to_first_click"]}) q
    WHERE q.session_id IN (SELECT session_id FROM closed)""")
def stream_first_clicks(spark, sf):
    """The session is named by its user here; a stream numbers no sessions."""
    out = _derived(spark, sf, "first-clicks", b.time_to_first_click)
    return out.drop("batch").withColumn("session_id", F.split_part("session_id", F.lit("@"), F.lit(1)).cast("long"))


@query("stream_activity", """WITH e AS (SELECT epoch_us(ts) // 1000 AS t, user_id FROM events), w AS (SELECT t, user_id, unnest(generate_series(t // 300000 * 300000 - 3300000, t // 300000 * 300000, 300000)) AS s FROM e)
    SELECT s AS window_start, count(*) AS events, count(DISTINCT user_id) AS sessions FROM w GROUP BY 1 HAVING s + 3600000 <= (SELECT max(t) FROM e) - 600000""")
def stream_activity(spark, sf):
    stream = event_stream(spark, sf).withColumn("session_id", F.col("user_id").cast("string"))
    path = work_path(spark, "activity")
    finish(kpis.follow_activity(stream, path, work_path(spark, "activity-progress")))
    return spark.read.parquet(f"{path}/activity").select(F.unix_millis("window_start").alias("window_start"), "events", "sessions")


@query("stream_motion", f"""{CLICKS} SELECT user_id, "timestamp" // 3600000 * 3600000 AS window_start, sum(p_x) AS distance_px, sum(k % 7) AS jitter_count FROM clicks GROUP BY 1, 2
    HAVING "timestamp" // 3600000 * 3600000 + 3600000 <= (SELECT max("timestamp") FROM clicks) - 10000""")
def stream_motion(spark, sf):
    moves = event_stream(spark, sf).select("user_id", "event_time", F.expr(PAYLOAD_SQL["x"]).alias("distance_px"), (F.col("k") % 7).cast("long").alias("jitter_count"))
    out = collected(spark, kpis.tumbling_motion(moves, ["user_id"], length="1 hour"), "motion")
    return out.select("user_id", F.unix_millis("window_start").alias("window_start"), "distance_px", "jitter_count")


@query("stream_centroids", f"""{SIMS}, nd AS (SELECT b.cluster, i, avg(x) AS n FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vecs) v
      JOIN best b USING (id) GROUP BY 1, 2)
    SELECT cluster, i - 1 AS i, round(coalesce(0.7 * c + 0.3 * n, c), 6) AS c FROM cd LEFT JOIN nd USING (cluster, i)""")
def stream_centroids(spark, sf):
    path = work_path(spark, "centroids")
    centroids(vectors_of(spark, sf)).write.parquet(f"{path}/version=0")
    vectors = table_stream(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), as_doubles(F.col("embedding")).alias("vector"))
    finish(kpis.follow_centroids(vectors, path, work_path(spark, "centroids-progress")))
    out = kpis.read_version(spark, path, 1)
    return out.select("cluster", F.posexplode("centroid").alias("i", "c")).withColumn("c", F.round("c", 6))


@query("tail_events", """SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'""")
def tail_events(spark, sf):
    return ingest.tail(raw_clicks(spark, sf), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("event_id")
