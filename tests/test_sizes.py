"""Queries on other tables than the small ones: folders of files, more rows."""

import os
import pickle
import random
import shutil

import pytest
from pyspark.sql import functions as F

from pathloom.functions import pages, tokens as tk
from pathloom.functions.rules import first_match
from pathloom.operators import quality as q
from pathloom.plans import load_queries
from pathloom.plans.check import difference, duck
from pathloom.plans.queries_live import _delivered
from pathloom.session import work_path
from pathloom.sources import sinks
from pathloom.streaming import kpis, live

QUERIES, CHECKS = load_queries()
SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def folders(spark, tmp_path, *names):
    """The small tables, the named ones as folders of several files."""
    for file in os.listdir(SMALL):
        name = file.removesuffix(".parquet")
        if name in names:
            spark.read.parquet(f"{SMALL}/{file}").repartition(3).write.parquet(f"{tmp_path}/{file}")
        else:
            shutil.copy(f"{SMALL}/{file}", f"{tmp_path}/{file}")
    return str(tmp_path)


def test_streams_read_folders(spark, tmp_path):
    sf = folders(spark, tmp_path, "events", "embeddings")
    con = duck(SMALL)
    for name in ("stream_centroids", "stream_sessions"):
        assert difference(QUERIES[name](spark, sf), con, CHECKS[name]) is None


def test_scan_is_as_long_as_its_sql_says(spark):
    assert difference(QUERIES["scan_events"](spark, LARGE), duck(LARGE), CHECKS["scan_events"]) is None


def test_activity_over_batches_without_a_row_per_window(spark):
    """Late events count for the windows still open; what is stored is one row per session and step."""
    r, path, out, progress = random.Random(4), *(work_path(spark, n) for n in ("in", "out", "progress"))
    minute, want, mark, seen, rows = 60_000, {}, None, set(), 0
    known = []
    for batch in range(4):
        some = [(r.choice(["a", "b", "c", None]), (batch * 90 + r.randrange(-80, 120)) * minute + r.randrange(minute)) for _ in range(60)]
        spark.createDataFrame(some, "session_id string, t long").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("session_id string, t long").parquet(path).withColumn("event_time", F.timestamp_millis("t"))
        kpis.follow_activity(stream, out, progress).awaitTermination()
        known += some
        mark = max(t for _, t in known) - 10 * minute
        steps = {t // (5 * minute) for _, t in known}
        for w in range(min(steps) - 11, max(steps) + 1):
            start = w * 5 * minute
            inside = [x for x in known if start <= x[1] < start + 60 * minute]
            if start + 60 * minute <= mark and w not in seen:
                seen.add(w)
                if inside:
                    want[start] = (len(inside), len({s for s, _ in inside} - {None}))
        rows += len({(s, t // (5 * minute)) for s, t in some})
    got = spark.read.parquet(f"{out}/activity").select(F.unix_millis("window_start"), "events", "sessions")
    assert {a: (b, c) for a, b, c in got.collect()} == want and len(want) > 20
    assert spark.read.parquet(f"{out}/buckets").count() == rows


def test_silhouettes_in_few_large_blocks(spark):
    """A vector travels twice per block: blocks grow with the rows, up to a bound, and their number does not change the result."""
    assert [q.block_count(n, 64) for n in (10_000, 100_000, 600_000)] == [4, 8, 10]
    r = random.Random(5)
    rows = [(i, i % 3, [r.gauss(i % 3, 1.0) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, cluster int, vector array<double>")
    one, many = ({x["id"]: x["silhouette"] for x in q.silhouettes(df, "id", cells).collect()} for cells in (1_000, 40))
    assert len(one) == 90 and one == pytest.approx(many)


def test_words_in_long_texts_need_no_expressions(spark):
    r, words = random.Random(6), []
    for rules in (pages.SECTION_NAMES, pages.SUBSECTION_NAMES, pages.AREAS, tk.TEXT_SEMANTICS):
        words += [w.removeprefix("(?i)") for _, ws in rules for w in ws]
    words += ["Size chart", "SIZEchart", "option_size", "Q&A", "ReView", "Delivery", "revıew", "x", "size then a chart", "shİp"]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(3)))) for i in range(600)] + [(600, None), (601, "")]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("low", F.lower("t"))
    t, low = F.col("t"), F.col("low")
    new = [pages.section_name(t, low), pages.subsection_name(t, low), tk.semantic_in_text(low), pages.area_in_text(low)]
    old = [first_match(low, pages.SECTION_NAMES), first_match(t, pages.SUBSECTION_NAMES), tk.semantic_from_text(t), pages.classify_area(t, F.lit(None))]
    out = df.select("t", F.array(*new).alias("new"), F.array(*old).alias("old"))
    assert out.where("not new <=> old").collect() == []
    assert out.select(F.explode("new").alias("x")).distinct().count() > 20
    assert "RLIKE" not in df.select(new[0], new[2], new[3])._jdf.queryExecution().optimizedPlan().toString()


def test_deliveries_are_written_by_many_tasks(spark, tmp_path):
    path, deliver = _delivered(spark, folders(spark, tmp_path, "events"), "event_id % 2 = 0")
    deliver()
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]) > 1


def test_waiting_events_share_values_of_the_state():
    """Each value of a state passes between Python and the JVM by itself."""
    rows = [(i, f"e{i}", None, 0.5) for i in range(2_500)]
    packs = live._packed(rows)
    assert len(packs) == 3
    assert [r for p in packs for r in pickle.loads(p[0])] == rows


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_padding_is_not_stored(spark, fmt):
    rows = [("a", 2, 2, [2, 9, 0, 0], [1, 1, 0, 0]), ("b", 0, 0, [0, 0, 0, 0], [0, 0, 0, 0]), ("c", 5, 4, [2, 7, 7, 8], [1, 1, 1, 1])]
    schema = "session_id string, original_length int, used_length int, input_ids array<int>, attention_mask array<int>"
    path = work_path(spark, "encoded")
    sinks.write_encoded(spark.createDataFrame(rows, schema), path, fmt, padded=False)
    got = sinks.read_encoded(spark, path, fmt).select("session_id", "used_length", "input_ids", "attention_mask").collect()
    assert sorted(map(tuple, got)) == [(r[0], *r[2:]) for r in rows]
    assert "attention_mask" not in spark.read.option("header", True).format(fmt).load(path).columns
