"""Stored collections without a shuffle, and versions of snapshots."""

import glob
import uuid

import pytest
from helpers import events
from pyspark.sql import functions as F

from pathloom.operators import sequences as sq, sessions as ss
from pathloom.session import work_path
from pathloom.sources import events as ev, snapshots as sn


def test_a_collection_is_read_without_an_exchange(spark):
    rows = None
    for s in "abcdefgh":
        some = events(spark, [(i * 700 % 5_000, "navigation" if i % 4 == 0 else "click", {"click_text": "Buy now"}, f"/product/{i}") for i in range(30)], s)
        rows = some if rows is None else rows.unionByName(some)
    rows = rows.withColumn("page_url", F.col("pathname"))
    name, path = f"c_{uuid.uuid4().hex}", work_path(spark, "collection")
    ev.save_collection(rows, name, 4, path)
    assert len(glob.glob(f"{path.removeprefix('file:')}/*.parquet")) <= 4
    stored = ev.read_collection(spark, name)
    for run in (lambda d: sq.semantic_sequences(d, bounded=True), lambda d: ss.event_seq(d, bounded=True), lambda d: ss.inter_event_gap(d, bounded=True)):
        assert "Exchange" not in run(stored)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in run(rows)._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, run(stored).collect())) == sorted(map(repr, run(rows).collect()))
    first = ev.read_collection(spark, name, ["session_id", "event_id"], 40).collect()
    want = rows.orderBy("session_id", "timestamp", "event_id").limit(40).select("session_id", "event_id").collect()
    assert sorted(first) == sorted(want)


@pytest.fixture
def root(spark):
    path = work_path(spark, "versions")

    def save(version, day, owner, *counts):
        rows = spark.createDataFrame([(owner, i, n) for i, n in enumerate(counts)], "origin string, cluster int, count long")
        sn.publish(rows if owner else rows.drop("origin"), path, version, F.lit(f"2024-01-{day:02}").cast("timestamp"), "origin" if owner else None)

    save("v2", 1, "https://A.example/", 1, 2)
    save("v1", 5, "https://a.example", 3)
    save("art", 1, None, 9, 8, 7)
    return path, save


def shown(spark, path, mode, live=None, sites=("a.example", "b.example")):
    chosen = sn.choose(spark.createDataFrame([(s,) for s in sites], "site string"), sn.newest(spark, path), mode, live)
    rows = sn.show(chosen, sn.versions(spark, path), live)
    return sorted(map(tuple, rows.select("site", "source", "cluster", "count").collect()))


def artifact(site, source):
    return [(site, source, i, n) for i, n in enumerate((9, 8, 7))]


def test_modes(spark, root):
    path, _ = root
    assert shown(spark, path, "frozen") == [("a.example", "site_snapshot", 0, 3), *artifact("b.example", "artifact_snapshot")]
    assert shown(spark, path, "artifact") == [*artifact("a.example", "artifact"), *artifact("b.example", "artifact")]
    assert shown(spark, path, "live") == [*artifact("a.example", "artifact_fallback"), *artifact("b.example", "artifact_fallback")]
    now = spark.createDataFrame([("b.example", 4, 11)], "site string, cluster int, count long")
    assert shown(spark, path, "live", now) == [*artifact("a.example", "artifact_fallback"), ("b.example", "site_live", 4, 11)]


def test_versions_replace_themselves_and_ties_go_to_the_larger_name(spark, root):
    path, save = root
    save("v1", 5, "https://a.example", 4, 4)
    assert shown(spark, path, "frozen", sites=("a.example",)) == [("a.example", "site_snapshot", 0, 4), ("a.example", "site_snapshot", 1, 4)]
    save("v3", 5, "https://a.example", 6)
    assert shown(spark, path, "frozen", sites=("a.example",)) == [("a.example", "site_snapshot", 0, 6)]


def test_a_version_without_pointer_is_not_seen(spark, root):
    path, _ = root
    spark.createDataFrame([("a.example", 0, 100)], "owner string, cluster int, count long").write.parquet(f"{path}/rows/version=v9")
    assert shown(spark, path, "frozen", sites=("a.example",)) == [("a.example", "site_snapshot", 0, 3)]


def test_no_artifact_and_no_snapshot(spark):
    path = work_path(spark, "versions")
    rows = spark.createDataFrame([("https://a.example", 0, 1)], "origin string, cluster int, count long")
    sn.publish(rows, path, "v1", F.lit("2024-01-01").cast("timestamp"))
    assert shown(spark, path, "frozen") == [("a.example", "site_snapshot", 0, 1)]
