"""Registered queries: vectors, centroids, cluster quality, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import vectors as vec
from pathloom.operators import clusters as cl, density, quality as q, profiles as pf
from pathloom.plans.fixtures import Clicks, table
from pathloom.plans.queries_encoding import vocab_of, vocab_sql
from pathloom.plans.queries_sequences import KEYS, SEQ, sequences_of
from pathloom.plans.registry import query
from pathloom.session import cut


def vectors_of(spark, sf, normalized=False, noise=False):
    """Embeddings as session vectors; with ``noise`` label 9 counts as noise."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), vec.as_doubles(F.col("embedding")).alias("vector"), F.col("label").alias("cluster")
    )
    if normalized:
        e = e.withColumn("vector", vec.l2_normalized(F.col("vector")))
    return e.withColumn("cluster", F.when(F.col("cluster") == 9, -1).otherwise(F.col("cluster"))) if noise else e


def vectors_sql(normalized=False, noise=False) -> str:
    label = "CASE WHEN label = 9 THEN -1 ELSE label END" if noise else "label"
    v = "CAST(embedding AS DOUBLE[])"
    if normalized:
        v = f"list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-9))"
    return f"vecs AS (SELECT vec_id AS id, {v} AS vector, {label} AS cluster FROM embeddings)"


CENTROIDS = """dims AS (SELECT id, cluster, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vecs WHERE cluster >= 0),
cd AS (SELECT cluster, i, avg(x) AS c FROM dims GROUP BY 1, 2),
cents AS (SELECT cluster, array_agg(c ORDER BY i) AS centroid FROM cd GROUP BY 1)"""
V = "WITH " + vectors_sql()
SIMS = f"""{V}, {CENTROIDS}, sims AS (SELECT v.id, c.cluster, list_dot_product(vector, centroid) / ((sqrt(list_dot_product(vector, vector)) + 1e-9)
    * (sqrt(list_dot_product(centroid, centroid)) + 1e-9)) AS s FROM vecs v, cents c),
    best AS (SELECT id, (array_agg(cluster ORDER BY s DESC, cluster))[1] AS cluster, max(s) AS similarity FROM sims GROUP BY 1)"""


@query("l2_normalize", f"""WITH {vectors_sql(True)} SELECT id, round(list_sum(vector), 6) AS total, round(vector[1], 6) AS first,
    round(sqrt(list_dot_product(vector, vector)), 6) AS norm FROM vecs""")
def l2_normalize(spark, sf):
    v = F.col("vector")
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return vectors_of(spark, sf, True).select(
        "id", F.round(total, 6).alias("total"), F.round(v[0], 6).alias("first"), F.round(vec.norm(v), 6).alias("norm")
    )


@query("centroids", f"{V}, {CENTROIDS} SELECT cluster, i - 1 AS i, round(c, 6) AS c FROM cd")
def centroids(spark, sf):
    out = cl.centroids(vectors_of(spark, sf))
    return out.select("cluster", F.posexplode("centroid").alias("i", "c")).withColumn("c", F.round("c", 6))


@query("assign_nearest", f"{SIMS} SELECT id, cluster, round(similarity, 6) AS similarity FROM best")
def assign_nearest(spark, sf):
    vectors = vectors_of(spark, sf)
    out = cl.assign_nearest(vectors.drop("cluster"), cl.centroids(vectors))
    return out.select("id", "cluster", F.round("similarity", 6).alias("similarity"))


@query("confidence_summary", f"""{SIMS} SELECT cluster, count(*) AS n, round(avg(similarity), 4) AS mean_confidence FROM best GROUP BY ROLLUP (cluster)""")
def confidence_summary(spark, sf):
    vectors = vectors_of(spark, sf)
    return cl.confidence_summary(cl.assign_nearest(vectors.drop("cluster"), cl.centroids(vectors)))


@query("classify_vectors", f"""{SIMS}, d AS (SELECT id, string_agg(concat(CAST(cluster AS VARCHAR), ':', printf('%.4f', 1 - s)), ' ' ORDER BY cluster) AS distances FROM sims GROUP BY 1)
    SELECT id, cluster, greatest(0, round(similarity, 4)) AS confidence, distances FROM best JOIN d USING (id)""")
def classify_vectors(spark, sf):
    vectors = vectors_of(spark, sf)
    out = cl.classify_vectors(vectors.drop("cluster"), cl.centroids(vectors))
    pairs = F.transform(
        F.array_sort(F.map_entries("distances")), lambda e: F.format_string("%d:%.4f", e["key"], e["value"])
    )
    return out.select("id", "cluster", "confidence", F.array_join(pairs, " ").alias("distances"))


@query("ema_centroids", f"""{SIMS}, nd AS (SELECT b.cluster, i, avg(x) AS n FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vecs) v
      JOIN best b USING (id) GROUP BY 1, 2)
    SELECT cluster, i - 1 AS i, round(coalesce(0.7 * c + 0.3 * n, c), 6) AS c FROM cd LEFT JOIN nd USING (cluster, i)""")
def ema_centroids(spark, sf):
    vectors = vectors_of(spark, sf)
    old = cut(cl.centroids(vectors))
    out = cl.ema_centroids(old, cl.assign_nearest(vectors.drop("cluster"), old))
    return out.select("cluster", F.posexplode("centroid").alias("i", "c")).withColumn("c", F.round("c", 6))


VN = "WITH " + vectors_sql(True, True)


@query("cluster_sizes", f"""{VN} SELECT count(*) AS sample_count, count(*) FILTER (cluster >= 0) AS clustered_session_count,
    count(*) FILTER (cluster < 0) AS noise_count, round(count(*) FILTER (cluster < 0) / count(*), 4) AS noise_rate FROM vecs""")
def cluster_sizes(spark, sf):
    return q.sizes_and_noise(vectors_of(spark, sf, True, True))


_SIL = f"""{VN}, c AS (SELECT * FROM vecs WHERE cluster >= 0),
    p AS (SELECT a.id, a.cluster, b.cluster AS near, sum(list_distance(a.vector, b.vector)) AS t, count(*) AS n FROM c a, c b GROUP BY 1, 2, 3),
    s AS (SELECT id, cluster, max(CASE WHEN near = cluster THEN t / (n - 1) END) AS a, min(CASE WHEN near <> cluster THEN t / n END) AS b FROM p GROUP BY 1, 2),
    sil AS (SELECT id, cluster, (b - a) / greatest(a, b) AS s FROM s)"""


@query("silhouette", f"{_SIL} SELECT round(avg(s), 4) AS silhouette FROM sil")
def silhouette(spark, sf):
    return q.silhouette(vectors_of(spark, sf, True, True), "id").select(F.round("silhouette", 4).alias("silhouette"))


@query("linear_silhouette", f"{_SIL.replace('list_distance(a.vector, b.vector)', 'list_distance(a.vector, b.vector) ** 2')} SELECT round(avg(s), 4) AS silhouette FROM sil")
def linear_silhouette(spark, sf):
    return q.linear_silhouette(vectors_of(spark, sf, True, True)).select(F.round("silhouette", 4).alias("silhouette"))


@query("silhouette_by_cluster", f"{_SIL} SELECT cluster, count(*) AS n, round(avg(s), 4) AS silhouette FROM sil GROUP BY 1")
def silhouette_by_cluster(spark, sf):
    each = q.silhouettes(vectors_of(spark, sf, True, True), "id")
    return each.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 4).alias("silhouette"))


_OWN = f"""{VN}, {CENTROIDS}, own AS (SELECT v.id, v.cluster, list_distance(vector, centroid) AS d FROM vecs v JOIN cents USING (cluster)),
    sp AS (SELECT cluster, avg(d) AS s, count(*) AS n, sum(d * d) AS w FROM own GROUP BY 1)"""


@query("davies_bouldin", f"""{_OWN}, r AS (SELECT a.cluster, max((a.s + b.s) / list_distance(ca.centroid, cb.centroid)) AS r FROM sp a JOIN cents ca USING (cluster),
      sp b JOIN cents cb USING (cluster) WHERE a.cluster <> b.cluster GROUP BY 1) SELECT round(avg(r), 4) AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf):
    return q.davies_bouldin(vectors_of(spark, sf, True, True)).select(F.round("davies_bouldin", 4).alias("davies_bouldin"))


@query("calinski_harabasz", f"""{_OWN}, g AS (SELECT i, avg(x) AS m FROM dims GROUP BY 1),
    b AS (SELECT sum(sp.n * (cd.c - g.m) ** 2) AS b FROM cd JOIN sp USING (cluster) JOIN g USING (i)), t AS (SELECT sum(w) AS w, sum(n) AS n, count(*) AS k FROM sp)
    SELECT round((b / (k - 1)) / (w / (n - k)), 2) AS calinski_harabasz FROM b, t""")
def calinski_harabasz(spark, sf):
    return q.calinski_harabasz(vectors_of(spark, sf, True, True)).select(F.round("calinski_harabasz", 2).alias("calinski_harabasz"))


@query("tf_vectors", f"""{SEQ}, {vocab_sql()}, c AS (SELECT session_id, id AS token_id, count(*) AS c FROM seq JOIN voc USING (token) GROUP BY 1, 2)
    SELECT session_id, token_id, round(c / sqrt(sum(c * c) OVER (PARTITION BY session_id)), 6) AS weight FROM c""")
def tf_vectors(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    out = cl.tf_vectors(long, vocabulary, KEYS)
    return out.select("session_id", "token_id", F.round("weight", 6).alias("weight"))


_ASSIGNED = "asg AS (SELECT DISTINCT session_id, user_id % 5 AS cluster FROM clicks)"
_TCENT = f"""{SEQ}, {vocab_sql()}, {_ASSIGNED}, tc0 AS (SELECT cluster, coalesce(id, 1) AS token_id, count(*) AS c FROM seq LEFT JOIN voc USING (token)
      JOIN asg USING (session_id) GROUP BY 1, 2),
    tc AS (SELECT cluster, token_id, c / sqrt(sum(c * c) OVER (PARTITION BY cluster)) AS weight FROM tc0)"""


def assignments(long):
    """Stand-in cluster labels: the user's number modulo 5."""
    return long.select(*KEYS).distinct().withColumn("cluster", (F.col("user_id") % 5).cast("int"))


@query("token_centroids", f"{_TCENT} SELECT cluster, token_id, round(weight, 6) AS weight FROM tc")
def token_centroids(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    out = cl.token_centroids(long, assignments(long), vocabulary, KEYS)
    return out.withColumn("weight", F.round("weight", 6))


@query("classify_sessions", f"""{_TCENT}, v0 AS (SELECT session_id, id AS token_id, count(*) AS c FROM seq JOIN voc USING (token) GROUP BY 1, 2),
    v AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY session_id)) AS w FROM v0), l AS (SELECT session_id, count(*) AS seq_len FROM seq GROUP BY 1),
    d AS (SELECT l.session_id, seq_len, k.cluster, 1 - coalesce((SELECT sum(v.w * tc.weight) FROM v JOIN tc USING (token_id) WHERE v.session_id = l.session_id AND tc.cluster = k.cluster), 0) AS d
      FROM l, (SELECT DISTINCT cluster FROM tc) k)
    SELECT session_id, any_value(seq_len) AS seq_len, greatest(0, round(1 - min(d), 4)) AS confidence,
      string_agg(concat(CAST(cluster AS VARCHAR), ':', printf('%.4f', d)), ' ' ORDER BY cluster) AS distances FROM d GROUP BY 1""")
def classify_sessions(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    vocabulary = cut(vocabulary)
    centres = cut(cl.token_centroids(long, assignments(long), vocabulary, KEYS))
    out = cl.classify_sessions(long, vocabulary, centres, KEYS, with_distances=True)
    pairs = F.transform(F.array_sort(F.map_entries("distances")), lambda e: F.format_string("%d:%.4f", e["key"], e["value"]))
    return out.select("session_id", "seq_len", "confidence", F.array_join(pairs, " ").alias("distances"))


@query("live_distribution", f"""{_TCENT}, site AS (SELECT session_id, max(received_at) AS last_at FROM clicks WHERE origin = 'https://site1' GROUP BY 1 ORDER BY 2 DESC, any_value(user_id), 1 LIMIT 500),
    own AS (SELECT * FROM seq WHERE session_id IN (SELECT session_id FROM site)), v0 AS (SELECT session_id, id AS token_id, count(*) AS c FROM own JOIN voc USING (token) GROUP BY 1, 2),
    v AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY session_id)) AS w FROM v0),
    d AS (SELECT session_id, cluster, round(sum(v.w * tc.weight), 9) AS s FROM v JOIN tc USING (token_id) GROUP BY 1, 2),
    b AS (SELECT session_id, cluster FROM d QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY s DESC, cluster) = 1)
    SELECT cluster, count(*) AS "count", sum(count(*)) OVER () AS total, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM b GROUP BY 1""")
def live_distribution(spark, sf):
    """The newest 500 sessions of a site, classified by the token centroids of all sites."""
    c, long, vocabulary = vocab_of(spark, sf)
    vocabulary = cut(vocabulary)
    centres = cut(cl.token_centroids(long, assignments(long), vocabulary, KEYS))
    site = c.df.where(F.col("origin") == "https://site1").groupBy(*KEYS).agg(F.max("received_at").alias("last_at"))
    return pf.live_distribution(long, site, vocabulary, centres, KEYS, 500)


@query("site_report", f"""{_TCENT}, site AS (SELECT session_id, max(received_at) AS last_at FROM clicks WHERE origin = 'https://site1' GROUP BY 1 ORDER BY 2 DESC, any_value(user_id), 1 LIMIT 120),
    own AS (SELECT * FROM seq WHERE session_id IN (SELECT session_id FROM site)), v0 AS (SELECT session_id, id AS token_id, count(*) AS c FROM own JOIN voc USING (token) GROUP BY 1, 2),
    v AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY session_id)) AS w FROM v0),
    d AS (SELECT session_id, cluster, round(sum(v.w * tc.weight), 9) AS s FROM v JOIN tc USING (token_id) GROUP BY 1, 2),
    b AS (SELECT session_id, cluster, s FROM d QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY s DESC, cluster) = 1),
    r AS (SELECT session_id, CASE WHEN round(coalesce(s, 0), 4) < 0.4 OR s IS NULL THEN -1 ELSE cluster END AS cluster FROM (SELECT DISTINCT session_id FROM own) LEFT JOIN b USING (session_id)),
    t AS (SELECT count(*) AS total, count(*) FILTER (cluster < 0) AS noise_count FROM r)
    SELECT cluster, count(*) AS "count", round(100 * count(*) / any_value(total), 1) AS session_share, any_value(noise_count) AS noise_count,
      CASE WHEN count(*) < 5 OR count(*) / any_value(total) < 0.05 THEN 'weak' ELSE 'verified' END AS status FROM r, t WHERE cluster >= 0 GROUP BY 1""")
def site_report(spark, sf):
    """The newest 120 sessions of a site by cluster, those unlike all clusters apart as noise."""
    c, long, vocabulary = vocab_of(spark, sf)
    vocabulary, labels = cut(vocabulary), assignments(long)
    centres = cut(cl.token_centroids(long, labels, vocabulary, KEYS))
    profiles = cut(pf.cluster_profiles(long, labels, KEYS))
    site = c.df.where(F.col("origin") == "https://site1").groupBy(*KEYS).agg(F.max("received_at").alias("last_at"))
    clusters, summary = pf.site_report(long, site, vocabulary, centres, profiles, KEYS, first_events=None, floor=0.4)
    noise = summary.select("noise_count").scalar()
    return clusters.select("cluster", "count", "session_share", noise.alias("noise_count"), "status")


@query("w2v_vectors")
def w2v_vectors(spark, sf):
    _, long = sequences_of(spark, sf)
    return cl.w2v_vectors(long, KEYS).select("session_id", "vector")


@query("plane_points")
def plane_points(spark, sf):
    return cl.plane_points(vectors_of(spark, sf)).select("id", "pca_x", "pca_y")


@query("cluster_sessions")
def cluster_sessions(spark, sf):
    return cl.cluster_sessions(vectors_of(spark, sf, True).drop("cluster")).select("id", "cluster", "probability")


@query("score_sequences", f"""WITH v AS (SELECT conv_id, array_agg(turn ORDER BY turn) AS ids FROM conversations GROUP BY 1)
    SELECT conv_id, round(list_avg(ids), 6) AS mean_id, round(list_avg(list_transform(ids, lambda x: x * x)), 6) AS mean_square FROM v""")
def score_sequences(spark, sf):
    import numpy as np

    from pathloom.operators.vocab import left_padded

    turns = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("pos"), F.col("turn").cast("int").alias("id"))
    ids = left_padded(turns, "id", 64, ["conv_id"], pad=-1).withColumnRenamed("values", "input_ids")
    ids = ids.withColumn("attention_mask", F.transform("input_ids", lambda x: F.when(x == -1, 0).otherwise(1)))

    def encoder(input_ids, mask):
        return np.stack([input_ids, input_ids * input_ids], axis=-1)

    out = cl.score_sequences(ids, encoder, ["conv_id"])
    return out.select("conv_id", F.round(F.col("vector")[0], 6).alias("mean_id"), F.round(F.col("vector")[1], 6).alias("mean_square"))


# predictions: the label is toxic, the cluster is the source, the score the length
_PRED = """WITH r AS (SELECT l.doc_id, l.toxic AS is_churned, CASE WHEN d.source = 'src0' THEN -1 ELSE CAST(substr(d.source, 4) AS INTEGER) END AS cluster, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
    rate AS (SELECT cluster, avg(is_churned) AS rt FROM r WHERE cluster >= 0 GROUP BY 1),
    y AS (SELECT doc_id, cluster, is_churned AS y_true, CASE WHEN cluster = -1 THEN 1.0 ELSE rt END AS y_prob FROM r LEFT JOIN rate USING (cluster)),
    p AS (SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM y),
    m AS (SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
          count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM p)"""


def labelled_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    number = F.regexp_extract("source", r"src(\d+)", 1).cast("int")
    return table(spark, sf, "labels").join(d, on="doc_id").select(
        "doc_id", F.col("toxic").alias("is_churned"), F.when(number == 0, -1).otherwise(number).alias("cluster"), "n_chars"
    )


@query("majority_predictions", f"{_PRED} SELECT doc_id, cluster, y_true, round(y_prob, 6) AS y_prob, y_pred FROM p")
def majority_predictions(spark, sf):
    out = q.majority_predictions(labelled_documents(spark, sf))
    return out.select("doc_id", "cluster", "y_true", F.round("y_prob", 6).alias("y_prob"), "y_pred")


@query("classification_metrics", f"""{_PRED} SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
    round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / (tp + tn + fp + fn), 6) AS f1_weighted FROM m""")
def classification_metrics(spark, sf):
    out = q.classification_metrics(q.majority_predictions(labelled_documents(spark, sf)))
    return out.select("tn", "fp", "fn", "tp", *(F.round(c, 6).alias(c) for c in out.columns[4:]))


@query("class_report", f"""{_PRED} SELECT 0 AS class, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall,
      round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1, tn + fp AS support FROM m
    UNION ALL SELECT 1, round(coalesce(tp / nullif(tp + fp, 0), 0), 6), round(coalesce(tp / nullif(tp + fn, 0), 0), 6),
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6), tp + fn FROM m""")
def class_report(spark, sf):
    out = q.class_report(q.majority_predictions(labelled_documents(spark, sf)))
    return out.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("auc_metrics", f"""{_PRED}, pr AS (SELECT *, n_chars % 50 AS s FROM r), k AS (SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) AS roc_auc
      FROM pr a, pr b WHERE a.is_churned = 1 AND b.is_churned = 0),
    g AS (SELECT s, sum(is_churned) AS pos, count(*) AS n FROM pr GROUP BY 1), h AS (SELECT s, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS nn FROM g WINDOW w AS (ORDER BY s DESC))
    SELECT round((SELECT roc_auc FROM k), 6) AS roc_auc, round(sum(pos * tp / nn) / sum(pos), 6) AS pr_auc FROM h""")
def auc_metrics(spark, sf):
    rows = labelled_documents(spark, sf).select(F.col("is_churned").alias("y_true"), (F.col("n_chars") % 50).cast("double").alias("y_prob"))
    return q.auc_metrics(rows).select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query("w2v_vectors_checks", f"{SEQ} SELECT DISTINCT session_id, 64 AS dims, true AS finite FROM seq")
def w2v_vectors_checks(spark, sf):
    """One vector of full length and finite numbers per session."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e6))
    return w2v_vectors(spark, sf).select("session_id", F.size("vector").alias("dims"), (~bad).alias("finite"))


@query("plane_points_checks", """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    t AS (SELECT sum(s) AS total FROM (SELECT sum(CAST(x AS DOUBLE) * x) AS s FROM v GROUP BY i))
    SELECT (SELECT count(*) FROM embeddings) AS n, true AS first_axis_widest, true AS uncorrelated, true AS within_total FROM t""")
def plane_points_checks(spark, sf):
    """Second moments of the axes: the first is the widest, they are uncorrelated and explain a part of the whole."""
    p = cl.plane_points(vectors_of(spark, sf))
    total = F.sum(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    x, y = F.var_pop("pca_x"), F.var_pop("pca_y")
    return p.agg(
        F.count(F.lit(1)).alias("n"), (x >= y).alias("first_axis_widest"), (F.abs(F.corr("pca_x", "pca_y")) < 1e-3).alias("uncorrelated"),
        ((x + y) * F.count(F.lit(1)) <= total * (1 + 1e-9)).alias("within_total"),
    )


@query("cluster_sessions_checks", """SELECT count(*) AS n, true AS in_range, true AS noise_is_zero, true AS little_noise FROM embeddings""")
def cluster_sessions_checks(spark, sf):
    """Every vector has a label, probabilities lie in 0 … 1 and are 0 for noise, and most vectors are no noise."""
    noise = F.col("cluster") == -1
    return cluster_sessions(spark, sf).agg(
        F.count("cluster").alias("n"), F.bool_and(F.col("probability").between(0, 1)).alias("in_range"),
        F.bool_and(~noise | (F.col("probability") == 0)).alias("noise_is_zero"), (F.count_if(noise) <= 0.2 * F.count(F.lit(1))).alias("little_noise"),
    )


def _bare(v: str, i: int) -> str:
    return f"CAST(floor(CAST({v}[{i}] AS DOUBLE) / 0.02) AS BIGINT)"


@query("density_clusters", f"""WITH RECURSIVE p AS (SELECT vec_id AS id, {_bare("embedding", 1)} AS x, {_bare("embedding", 2)} AS y FROM embeddings),
    c AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2),
    nb AS (SELECT a.x, a.y, a.n, sum(b.n) AS near FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3),
    dn AS (SELECT * FROM nb WHERE near >= 12),
    go AS (SELECT x, y, x AS rx, y AS ry FROM dn UNION SELECT b.x, b.y, go.rx, go.ry FROM go JOIN dn b ON abs(go.x - b.x) <= 1 AND abs(go.y - b.y) <= 1),
    rt AS (SELECT x, y, min(struct_pack(x := rx, y := ry)) AS r FROM go GROUP BY 1, 2),
    bd AS (SELECT s.x, s.y, (max(struct_pack(near := d.near, x := d.x, y := d.y, r := rt.r))).r AS r FROM nb s JOIN dn d ON abs(s.x - d.x) <= 1 AND abs(s.y - d.y) <= 1
      JOIN rt ON rt.x = d.x AND rt.y = d.y WHERE s.near < 12 GROUP BY 1, 2),
    al AS (SELECT x, y, r FROM rt UNION ALL SELECT x, y, r FROM bd),
    rk AS (SELECT r, row_number() OVER (ORDER BY sum(c.n) DESC, r) - 1 AS cluster FROM al JOIN c USING (x, y) GROUP BY r)
    SELECT id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM p LEFT JOIN al USING (x, y) LEFT JOIN rk USING (r)""")
def density_clusters(spark, sf):
    """Dense groups in the plane of the first two components; how much is noise follows from the points alone."""
    points = vectors_of(spark, sf).select("id", F.slice("vector", 1, 2).alias("vector"))
    return density.cluster_by_density(points, 0.02, 12).select("id", "cluster")
