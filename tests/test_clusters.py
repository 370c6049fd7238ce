"""Centroids in one block and in several give the same results, and nothing is collected for several."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions.vectors import l2_normalized
from pathloom.operators import clusters as cl, profiles as pf, quality as q
from pathloom.operators.refresh import refresh_centroids

VECTORS = "id int, vector array<double>, cluster int, cell string"


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 6))
    centres[7] = centres[3]  # a tie goes to the lower id
    rows = [(i, (centres[i % 40] + r.normal(scale=0.2, size=6)).tolist(), int(i % 41) - 1, "c") for i in range(600)]
    return spark.createDataFrame(rows, VECTORS).repartition(6).cache(), spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centroid array<double>").cache()


def rows(df, *columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("cells", [100, 400])
def test_nearest_in_blocks(made, cells):
    vectors, table = made
    mine = vectors.drop("cluster")
    one, several = cl.assign_nearest(mine, table), cl.assign_nearest(mine, table, cells=cells)
    assert several.columns == one.columns
    assert rows(several, "id", "cluster", "similarity") == rows(one, "id", "cluster", "similarity")
    assert 7 not in {r["cluster"] for r in several.collect()}


def test_nothing_is_collected_for_several_blocks(made):
    _, table = made
    assert cl.one_block(table, 100) is None
    ids, matrix = cl.one_block(table)
    assert matrix.shape == (40, 6) and list(ids) == list(range(40))
    blocked, count = cl.in_blocks(table, 100)
    assert count == 3 and max(r["count"] for r in blocked.groupBy("__block").count().collect()) <= 16


def test_own_distance_in_blocks(made):
    vectors, table = made
    known = vectors.where("cluster >= 0")
    assert rows(cl.own_distance(known, table, 50), "id", "own_distance") == rows(cl.own_distance(known, table), "id", "own_distance")


def test_distances_need_one_block(made):
    vectors, table = made
    with pytest.raises(ValueError):
        cl.distances(vectors, table, cells=50)
    plain = cl.classify_vectors(vectors.drop("cluster"), table, with_distances=False)
    full = cl.classify_vectors(vectors.drop("cluster"), table)
    assert "distances" not in plain.columns and rows(plain, "id", "cluster", "confidence") == rows(full, "id", "cluster", "confidence")


def test_no_centroids(spark, made):
    vectors, table = made
    assert {r["cluster"] for r in cl.assign_nearest(vectors.drop("cluster"), table.limit(0)).collect()} == {None}


@pytest.mark.parametrize("cells", [50, 65_536])
def test_davies_bouldin_in_blocks(made, cells):
    vectors, _ = made
    known = [(r["cluster"], np.array(r["vector"])) for r in vectors.collect() if r["cluster"] >= 0]
    names = sorted({c for c, _ in known})
    centre = {c: np.mean([v for k, v in known if k == c], axis=0) for c in names}
    spread = {c: np.mean([np.linalg.norm(v - centre[c]) for k, v in known if k == c]) for c in names}
    want = np.mean([max((spread[a] + spread[b]) / np.linalg.norm(centre[a] - centre[b]) for b in names if b != a) for a in names])
    assert q.davies_bouldin(vectors, cells).first()[0] == pytest.approx(want)


def test_davies_bouldin_needs_two_clusters(made):
    vectors, _ = made
    assert q.davies_bouldin(vectors.where("cluster = 1")).first()[0] is None
    assert q.davies_bouldin(vectors.limit(0)).first()[0] is None


def test_equal_centroids_count_as_no_ratio(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)], i // 2, "") for i in range(4)], VECTORS)
    assert q.davies_bouldin(df).first()[0] == 0.0


def test_session_without_known_token_goes_to_the_first_cluster(spark):
    long = spark.createDataFrame([("s", "a"), ("t", "zz")], "session_id string, token string")
    vocab = spark.createDataFrame([("a", 5)], "token string, id int")
    table = spark.createDataFrame([(4, 5, 1.0), (2, 6, 1.0)], "cluster int, token_id int, weight double")
    got = {r["session_id"]: (r["cluster"], r["confidence"]) for r in cl.classify_sessions(long, vocab, table, ["session_id"]).collect()}
    assert got == {"s": (4, 1.0), "t": (2, 0.0)}
    whole = cl.classify_sessions(long, vocab, table, ["session_id"], True).where(F.col("session_id") == "s").first()
    assert whole["distances"] == {2: 1.0, 4: 0.0}


def test_the_norm_is_computed_once_per_vector(spark):
    wide = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    start = time.perf_counter()
    out = wide.select(l2_normalized(F.col("v")).alias("v")).select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    # a norm per element would be 1 000 000 000 steps
    assert time.perf_counter() - start < 10
    assert all(r["n"] == pytest.approx(1.0) for r in out)
    odd = spark.createDataFrame([(None,), ([],), ([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalized(F.col("v")).alias("v"))
    assert [r["v"] for r in odd.collect()] == [None, [], [3.0 / (5.0 + 1e-9), 4.0 / (5.0 + 1e-9)], [0.0, 0.0]]


@pytest.mark.parametrize("full", [False, True])
def test_refresh_keeps_the_vectors_as_they_were(spark, full):
    r = np.random.default_rng(5)
    given = {f"s{i}": (r.normal(size=4) * 0.05 + np.eye(4)[i % 4] * 5).tolist() for i in range(80)}
    vectors = spark.createDataFrame(list(given.items()), "session_id string, vector array<double>")
    long = spark.createDataFrame([(s, "HOME|ENTER_HOME|NONE") for s in given], "session_id string, token string")
    old = spark.createDataFrame([(i, np.eye(4)[i].tolist()) for i in range(4)], "cluster int, centroid array<double>")
    before = pf.cluster_profiles(long, spark.createDataFrame([(s, int(s[1:]) % 4) for s in given], "session_id string, cluster int"), ["session_id"])
    out = refresh_centroids(vectors, long, old, before, ["session_id"], full=full, ks=(4,))
    labels = {x["session_id"]: x["cluster"] for x in out["assignments"].collect()}
    assert set(labels) == set(given)
    for row in out["centroids"].collect():
        mean = np.mean([given[s] for s, c in labels.items() if c == row["cluster"]], axis=0)
        want = mean if full else 0.7 * np.eye(4)[row["cluster"]] + 0.3 * mean
        assert row["centroid"] == pytest.approx(want.tolist())
    measures = out["quality"].first()
    assert measures["sample_count"] == 80 and measures["silhouette"] > 0.9
