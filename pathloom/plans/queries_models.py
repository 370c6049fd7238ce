"""Registered queries: churn model, centroid refresh, result joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import churn, clusters as cl, features, profiles as pf
from pathloom.operators.refresh import refresh_centroids as refresh
from pathloom.operators.sequences import in_parts
from pathloom.plans.fixtures import Clicks, clicks_sql
from pathloom.plans.queries_clusters import CENTROIDS, V, vectors_of
from pathloom.plans.queries_reports import ASG, assigned
from pathloom.plans.queries_sequences import KEYS, SEQ, sequences_of
from pathloom.plans.registry import query
from pathloom.session import cut, work_path

CLICKS = "WITH " + clicks_sql()


@query("churn_model")
def churn_model(spark, sf):
    rows = cut(features.session_features(Clicks(spark, sf).df, KEYS))
    # the flags that define the label are left out
    rows = rows.drop("add_to_cart_flag", "add_to_cart_count", "purchase_click_flag", "cart_abandon_flag", "cart_indecision_flag")
    model, _ = churn.train(rows)
    return churn.predict(model, rows)


def _refreshed(spark, sf, full):
    _, long = sequences_of(spark, sf)
    long = cut(long)
    vectors = cut(cl.w2v_vectors(long, KEYS, size=64))
    labels = assigned(long).where("cluster >= 0")
    old = cut(cl.centroids(vectors.join(labels, on=KEYS)).select("cluster", "centroid"))
    return refresh(vectors, long, old, cut(pf.cluster_profiles(long, labels, KEYS)), KEYS, work_path(spark, "refresh"), full=full)


@query("refresh_centroids")
def refresh_centroids(spark, sf):
    return _refreshed(spark, sf, False)["quality"]


@query("refresh_centroids_full")
def refresh_centroids_full(spark, sf):
    return _refreshed(spark, sf, True)["profiles"].select("cluster", "count", "label", "status", "stability")


@query("refresh_moved", f"""{V}, {CENTROIDS}, o AS (SELECT cluster, list_transform(centroid, lambda x: x + 0.01 * cluster) AS centroid FROM cents),
    sims AS (SELECT v.id, o.cluster, list_dot_product(vector, o.centroid) / ((sqrt(list_dot_product(vector, vector)) + 1e-9)
      * (sqrt(list_dot_product(o.centroid, o.centroid)) + 1e-9)) AS s FROM vecs v, o),
    best AS (SELECT id, (array_agg(cluster ORDER BY s DESC, cluster))[1] AS cluster FROM sims GROUP BY 1),
    unit AS (SELECT v.id, best.cluster, list_transform(vector, lambda x: x / (sqrt(list_dot_product(vector, vector)) + 1e-9)) AS u FROM vecs v JOIN best USING (id)),
    ud AS (SELECT id, cluster, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM unit),
    mc AS (SELECT cluster, i, avg(x) AS c FROM ud GROUP BY 1, 2), m AS (SELECT cluster, array_agg(c ORDER BY i) AS c FROM mc GROUP BY 1),
    far AS (SELECT cluster, avg(list_distance(u, m.c)) AS s FROM unit JOIN m USING (cluster) GROUP BY 1),
    db AS (SELECT a.cluster, max((a.s + b.s) / list_distance(ma.c, mb.c)) AS r FROM far a JOIN m ma USING (cluster), far b JOIN m mb USING (cluster) WHERE a.cluster <> b.cluster GROUP BY 1),
    sq AS (SELECT a.id, a.cluster, b.cluster AS other, sum(list_distance(a.u, b.u) ** 2) AS d, count(*) AS n FROM unit a, unit b GROUP BY 1, 2, 3),
    sl AS (SELECT id, max(CASE WHEN cluster = other THEN CASE WHEN n = 1 THEN NULL ELSE d / (n - 1) END END) AS a, min(CASE WHEN cluster <> other THEN d / n END) AS b FROM sq GROUP BY 1)
    SELECT (SELECT count(*) FROM unit) AS sample_count, (SELECT count(*) FROM unit) AS clustered_session_count, 0 AS noise_count, 0.0 AS noise_rate,
      round((SELECT avg(r) FROM db), 3) AS davies_bouldin, round((SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM sl), 3) AS silhouette""")
def refresh_moved(spark, sf):
    """Quality after one refresh of embeddings around shifted centroids; assignment and measures are checked from the vectors."""
    vectors = cut(vectors_of(spark, sf).select(F.col("id").alias("session_id"), "vector", F.col("cluster").alias("label")))
    own = cl.centroids(vectors.withColumnRenamed("label", "cluster")).select("cluster", "centroid")
    old = cut(own.withColumn("centroid", F.transform("centroid", lambda x: x + 0.01 * F.col("cluster"))))
    long = vectors.select("session_id", F.lit(1).alias("pos"), F.concat(F.lit("HOME|A"), F.col("label").cast("string"), F.lit("|NONE")).alias("token"))
    profiles = cut(pf.cluster_profiles(long, vectors.select("session_id", F.col("label").alias("cluster")), ["session_id"]))
    quality = refresh(vectors.drop("label"), long, old, profiles, ["session_id"])["quality"]
    return quality.drop("avg_profile_stability").withColumns({c: F.round(c, 3) for c in ("davies_bouldin", "silhouette")})


@query("results_with_sequences", f"""{SEQ}, {ASG} SELECT session_id, cluster, (pos - 1) // 4096 AS part, string_agg(token, ' ' ORDER BY pos) AS "sequence"
    FROM asg LEFT JOIN seq USING (session_id) GROUP BY 1, 2, 3""")
def results_with_sequences(spark, sf):
    """Cluster results with their whole sequences, a long one in parts."""
    c, long = sequences_of(spark, sf)
    results = c.df.select(*KEYS).distinct().withColumn("cluster", (F.col("user_id") % 6 - 1).cast("int"))
    out = results.join(in_parts(long, KEYS, "token"), on=KEYS, how="left")
    return out.select("session_id", "cluster", "part", F.array_join("values", " ").alias("sequence"))


@query("churn_model_checks", f"{CLICKS} SELECT DISTINCT session_id, true AS in_range, true AS agrees FROM clicks")
def churn_model_checks(spark, sf):
    """One prediction per session: a probability, and a decision that follows it."""
    p = churn_model(spark, sf)
    return p.select("session_id", F.col("y_prob").between(0, 1).alias("in_range"), ((F.col("y_prob") > 0.5).cast("int") == F.col("y_pred")).alias("agrees"))


@query("one_hot", f"""{CLICKS}, f AS (SELECT session_id, (array_agg(device_type ORDER BY "timestamp", event_id))[1] AS device_type, count(*) AS n FROM clicks GROUP BY 1)
    SELECT session_id, device_type, 1.0 AS total, n + 1.0 AS whole FROM f""")
def one_hot(spark, sf):
    """Texts become one flag each, numbers stay: the flag that is set names the value again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    events = Clicks(spark, sf).df
    rank = F.struct("timestamp", "event_id")
    rows = cut(events.groupBy("session_id").agg(F.min_by("device_type", rank).alias("device_type"), F.count(F.lit(1)).cast("double").alias("n")))
    model = Pipeline(stages=churn.projection(rows)).fit(rows)
    names = F.array(*(F.lit(x) for x in model.stages[0].labelsArray[0]))
    out = model.transform(rows).select("session_id", vector_to_array("device_type__v").alias("v"), vector_to_array("features").alias("x"))
    total = [F.aggregate(c, F.lit(0.0), lambda a, b: a + b) for c in ("v", "x")]
    return out.select(
        "session_id", F.element_at(names, F.array_position("v", 1.0).cast("int")).alias("device_type"), total[0].alias("total"), total[1].alias("whole")
    )


@query("kept_sessions", f"{CLICKS} SELECT DISTINCT session_id FROM clicks WHERE event_type IN ('add_to_cart', 'purchase_click')")
def kept_sessions(spark, sf):
    """Converted sessions: a semi-join by flag."""
    return features.churn_labels(Clicks(spark, sf).df, KEYS).where("is_churned = 0").select("session_id")


@query("joint_vocabulary", f"""{SEQ}, u AS (SELECT token FROM seq UNION ALL SELECT event_type FROM clicks)
    SELECT token, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS id FROM u GROUP BY 1""")
def joint_vocabulary(spark, sf):
    """One vocabulary over the tokens of two sources."""
    from pathloom.operators.vocab import build_vocab

    c, long = sequences_of(spark, sf)
    both = long.select("token").unionByName(c.df.select(F.col("event_type").alias("token")))
    return build_vocab(both).where("freq IS NOT NULL")
