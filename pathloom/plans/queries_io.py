"""Registered queries: what is written comes back the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathloom.operators import features, sequences as sq, vocab as vo
from pathloom.operators.sequences import token_lists
from pathloom.plans.fixtures import Clicks, clicks_sql, raw_clicks, table
from pathloom.plans.queries_encoding import vocab_of, vocab_sql
from pathloom.plans.queries_reports import PROF, _text, profiles_of
from pathloom.plans.queries_sequences import KEYS, SEQ
from pathloom.plans.queries_sessions import FEATURES_SQL
from pathloom.plans.registry import query
from pathloom.session import cut, work_path
from pathloom.sources import events as ev, sinks, snapshots

CLICKS = "WITH " + clicks_sql()
_EVENT = ["event_id", "event_type", "timestamp", "page_url", "origin"]


def _wire(spark, sf):
    """Events as a collector sends them, with the payload as an object."""
    e = raw_clicks(spark, sf).withColumn("data", F.from_json("data", "depth_pct double, section string"))
    return e.withColumn("event_id", F.col("event_id").cast("string")).select("user_id", F.struct(*_EVENT, "data").alias("e"))


_READ = f"""{CLICKS} SELECT event_id, event_type, "timestamp", page_url, origin, p_depth_pct AS depth_pct, p_section AS section FROM clicks"""


def _read_back(df):
    p = F.from_json("data", "depth_pct double, section string")
    return df.select(F.col("event_id").cast("long").alias("event_id"), *_EVENT[1:], p["depth_pct"].alias("depth_pct"), p["section"].alias("section"))


@query("json_lines_source", _READ)
def json_lines_source(spark, sf):
    path = work_path(spark, "events-json")
    _wire(spark, sf).select("e.*").write.json(path)
    return _read_back(ev.read_json(spark, path))


@query("json_batches_source", _READ)
def json_batches_source(spark, sf):
    path = work_path(spark, "events-batches")
    # 30 events per batch, as a collector sends them
    batch = F.floor(F.col("e.event_id").cast("long") / 30)
    _wire(spark, sf).groupBy(batch).agg(F.collect_list("e").alias("events")).select("events").write.json(path)
    return _read_back(ev.read_json(spark, path))


@query("csv_source", _READ)
def csv_source(spark, sf):
    path = work_path(spark, "events-csv")
    raw_clicks(spark, sf).select(*_EVENT, "data").write.csv(path, header=True, quote='"', escape='"')
    return _read_back(ev.read_csv(spark, path))


@query("external_source", """SELECT CAST(user_id AS VARCHAR) AS session_id_hash, event_type, epoch_us(ts) // 1000 AS server_timestamp_epoch_ms FROM events""")
def external_source(spark, sf):
    path = work_path(spark, "external")
    e = table(spark, sf, "events")
    e.select(
        F.col("user_id").cast("string").alias("session_id_hash"), "event_type", F.lit("detail").alias("product_action"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("server_timestamp_epoch_ms"), F.col("props").alias("other"),
    ).write.csv(path, header=True, quote='"', escape='"')
    return ev.read_external(spark, path).select("session_id_hash", "event_type", "server_timestamp_epoch_ms")


@query("feature_sink", f"{CLICKS}, {FEATURES_SQL} SELECT session_id, click_count, is_churned, utm_source FROM features")
def feature_sink(spark, sf):
    path = sinks.write_features(features.session_features(Clicks(spark, sf).df, KEYS), work_path(spark, "features"))
    back = spark.read.csv(path, header=True, schema=None, inferSchema=False)
    return back.select("session_id", F.col("click_count").cast("long").alias("click_count"), F.col("is_churned").cast("int").alias("is_churned"), "utm_source")


def _texts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("session_id"), F.col("n_chars").alias("start_timestamp"), F.col("n_chars").alias("end_timestamp"),
        F.lit(3).cast("long").alias("length"), F.split(F.concat_ws("  ", "lang", "source", F.lit("x")), "  ").alias("sequence"),
    )


_SEQ_BACK = """SELECT CAST(doc_id AS VARCHAR) AS session_id, n_chars AS start_timestamp, concat(lang, ' ', source, ' x') AS "sequence" FROM documents"""


def _seq_back(df):
    return df.select("session_id", "start_timestamp", F.array_join("sequence", " ").alias("sequence"))


@query("sequences_csv", _SEQ_BACK)
def sequences_csv(spark, sf):
    path = work_path(spark, "seq-csv")
    sinks.write_sequences(_texts(spark, sf), path)
    return _seq_back(ev.read_sequences(spark, path))


@query("sequences_json", _SEQ_BACK)
def sequences_json(spark, sf):
    path = work_path(spark, "seq-json")
    sinks.write_sequences(_texts(spark, sf), path, "json")
    return _seq_back(ev.read_sequences(spark, path, "json"))


@query("token_lists", """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, token FROM (
    SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, ' \t\n\r'), '\\s+'), lambda x: x <> '') AS w FROM documents))""")
def token_lists_(spark, sf):
    d = table(spark, sf, "documents").withColumn("text", F.trim(F.col("text"), F.lit(" \t\n\r")))
    return token_lists(d, "text", "doc_id")


@query("vocab_sink", f"{SEQ}, {vocab_sql()} SELECT token, id FROM voc UNION ALL VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[MASK]', 3)")
def vocab_sink(spark, sf):
    path = work_path(spark, "vocab")
    sinks.write_vocab(vocab_of(spark, sf)[2], path)
    return ev.read_vocab(spark, path)


@query("cluster_results", "SELECT vec_id AS id, label AS cluster, 1.0 AS probability FROM embeddings")
def cluster_results(spark, sf):
    path = work_path(spark, "clusters")
    e = table(spark, sf, "embeddings")
    sinks.write_clusters(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.lit(1.0).alias("probability")), path)
    return sinks.read_clusters(spark, path)


@query("site_snapshots", f"""{PROF}, s AS (SELECT * FROM (VALUES ('site0'), ('site1'), ('site2')) AS t(site))
    SELECT site, cluster, CASE site WHEN 'site1' THEN "count" * 2 WHEN 'site0' THEN "count" ELSE "count" END AS "count", top_actions,
      CASE site WHEN 'site2' THEN 'global_meta_fallback' ELSE 'site_snapshot' END AS source FROM prof, s""")
def site_snapshots(spark, sf):
    """Two sites have snapshots, one of them saved twice; the third falls back to the global profiles."""
    profiles = cut(profiles_of(spark, sf)[2])
    path = work_path(spark, "snapshots")

    def snapshot(origin, times):
        return profiles.withColumns({"origin": F.lit(origin), "count": F.col("count") * times})

    sinks.save_snapshots(snapshot("https://site0/", 1).unionByName(snapshot("https://Site1", 5)), path, F.lit(1))
    sinks.save_snapshots(snapshot("https://site1/", 2), path, F.lit(2))
    from pathloom.functions.urls import site_key

    sites = raw_clicks(spark, sf).select(site_key(F.col("origin")).alias("site")).distinct()
    out = sinks.with_fallback(sites, sinks.load_snapshots(spark, path), profiles)
    return out.select("site", "cluster", "count", _text("top_actions", "action"), "source")


@query("latest_artifact", "SELECT 'run-' || CAST(max(o_orderkey) AS VARCHAR) AS path FROM orders")
def latest_artifact(spark, sf):
    runs = table(spark, sf, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("modificationTime"))
    return sinks.latest(runs).select("path")


@query("parse_payload", f"""{CLICKS} SELECT event_id, p_depth_pct AS depth_pct, p_section AS section, p_click_text AS click_text, p_bounce_flag AS bounce_flag FROM clicks""")
def parse_payload_(spark, sf):
    from pathloom.functions.payload import parse_payload

    e = raw_clicks(spark, sf).withColumn("p", parse_payload(F.col("data")))
    return e.select("event_id", *(F.col(f"p.{n}").alias(n) for n in ("depth_pct", "section", "click_text", "bounce_flag")))


@query("table_source", "SELECT event_id, event_type FROM events")
def table_source(spark, sf):
    """A table of the catalog, two columns of it."""
    table(spark, sf, "events").createOrReplaceTempView("pathloom_events")
    return ev.read_table(spark, "pathloom_events", ["event_id", "event_type"])


@query("audit_sink", f"{SEQ} SELECT session_id, pos, token FROM seq")
def audit_sink(spark, sf):
    path = work_path(spark, "audit")
    sinks.write_audit(vocab_of(spark, sf)[1].select("session_id", "pos", "token"), path)
    return spark.read.schema("session_id string, pos long, token string").json(path)


@query("encoded_sink", f"{SEQ}, {vocab_sql()} SELECT session_id, len(array_agg(id)) + 1 AS used_length, 2 AS first_id, array_agg(id ORDER BY pos)[1] AS second_id FROM seq JOIN voc USING (token) GROUP BY session_id")
def encoded_sink(spark, sf):
    """Encoded sequences as CSV and back."""
    _, long, vocabulary = vocab_of(spark, sf)
    path = work_path(spark, "encoded")
    sinks.write_encoded(vo.encode_sequences(long, vocabulary, 4_096, KEYS), path, "csv", padded=False)
    ids = F.col("input_ids")
    return sinks.read_encoded(spark, path, "csv").select("session_id", "used_length", ids[0].alias("first_id"), ids[1].alias("second_id"))


@query("ordered_collection", f"{SEQ} SELECT session_id, pos, token FROM seq")
def ordered_collection(spark, sf):
    """Events stored by session and time; the sequences read them without a shuffle."""
    name = f"events_{uuid.uuid4().hex}"
    c = Clicks(spark, sf)
    ev.save_collection(c.df, name, 8, work_path(spark, "collection"))
    return sq.semantic_sequences(ev.read_collection(spark, name), bounded=c.bounded)


_MODES_SQL = f"""{PROF}, s AS (SELECT * FROM (VALUES ('site0'), ('site1'), ('site2')) AS t(site)), m AS (SELECT * FROM (VALUES ('frozen'), ('live'), ('artifact')) AS t(mode)),
    x AS (SELECT mode, site, CASE WHEN mode = 'frozen' AND site <> 'site2' THEN 'site_snapshot' WHEN mode = 'frozen' THEN 'artifact_snapshot'
        WHEN mode = 'live' AND site = 'site1' THEN 'site_live' WHEN mode = 'live' THEN 'artifact_fallback' ELSE 'artifact' END AS source FROM s, m),
    n AS (SELECT user_id % 6 - 1 AS cluster, count(DISTINCT session_id) AS "count" FROM clicks WHERE origin = 'https://site1' GROUP BY 1)
    SELECT mode, site, source, prof.cluster, prof."count" * CASE WHEN source <> 'site_snapshot' THEN 1 WHEN site = 'site1' THEN 3 ELSE 2 END AS "count", top_actions
    FROM x, prof WHERE source <> 'site_live'
    UNION ALL SELECT mode, site, source, n.cluster, n."count", top_actions FROM x, n LEFT JOIN prof USING (cluster) WHERE source = 'site_live' AND n.cluster >= 0"""


@query("snapshot_modes", _MODES_SQL)
def snapshot_modes(spark, sf):
    """What three sites show when frozen, live and as the artifact; site0 and site1 have snapshots, site1 two, and only site1 is classified now."""
    c, _, profiles = profiles_of(spark, sf)
    profiles = cut(profiles)
    root = work_path(spark, "versions")

    def of(origin, times):
        return profiles.withColumns({"origin": F.lit(origin), "count": F.col("count") * times})

    def at(day):
        return F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp")

    snapshots.publish(of("https://site0/", 2).unionByName(of("https://Site1", 5)), root, "v1", at(1))
    snapshots.publish(of("https://site1/", 3), root, "v0", at(2))  # saved later, whatever its name
    snapshots.publish(profiles, root, "all", at(1), None)
    site1 = c.df.where(F.col("origin") == "https://site1").select(*KEYS).distinct()
    counts = site1.groupBy((F.col("user_id") % 6 - 1).cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("count")).where("cluster >= 0")
    live = counts.join(profiles.drop("count"), "cluster", "left").withColumn("site", F.lit("site1"))
    from pathloom.functions.urls import site_key

    sites = raw_clicks(spark, sf).select(site_key(F.col("origin")).alias("site")).distinct()
    pointers, published = cut(snapshots.newest(spark, root)), snapshots.versions(spark, root)
    out = None
    for mode in ("frozen", "live", "artifact"):
        now = live if mode == "live" else None
        rows = snapshots.show(snapshots.choose(sites, pointers, mode, now), published, now).withColumn("mode", F.lit(mode))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("mode", "site", "source", "cluster", "count", _text("top_actions", "action"))
