import json
import random

from pyspark.sql import functions as F

from pathloom.session import work_path
from pathloom.streaming import ingest, sessions as ss


def deliver(spark, batches):
    """One file per batch, in order of delivery."""
    path = work_path(spark, "delivered")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(json.dumps({"events": rows}),)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def event(i, ts, user=1):
    return {"event_id": None if i is None else f"e{i}", "session_id": f"u{user}", "event_type": "click", "timestamp": ts}


def stored(spark, path):
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(path)
    accepted = ingest.accept(raw, F.lit("https://m.Shop.example/x"), F.current_timestamp())
    timed = accepted.withColumn("event_time", ingest.event_time(F.col("timestamp")))
    out, progress = work_path(spark, "out"), work_path(spark, "progress")
    query = ingest.append(ingest.once(timed, "1 hour"), out, progress)
    query.awaitTermination()
    return spark.read.parquet(out)


def test_repeated_deliveries_are_stored_once(spark):
    r = random.Random(1)
    rows = [event(i, 1_700_000_000_000 + i * 1000) for i in range(40)]
    batches = [rows[i : i + 10] for i in range(0, 40, 10)]
    batches += [r.sample(b, 6) for b in batches]
    r.shuffle(batches)
    batches.append([event(None, 1_700_000_000_000), event(None, 1_700_000_000_000), {"no": "type"}])
    out = stored(spark, deliver(spark, batches)).collect()
    ids = [x["event_id"] for x in out]
    assert sorted(i for i in ids if i) == sorted(f"e{i}" for i in range(40))
    assert ids.count(None) == 2
    assert {x["origin"] for x in out} == {"https://shop.example"}


def test_sessions_follow_event_time_not_arrival(spark):
    minute = 60_000
    base = 1_700_000_000_000
    times = [base + i * minute for i in (0, 5, 20, 60, 70, 200)]  # timeout 30 minutes: 3 + 2 + 1 events
    rows = [(1, t, i, f"src{i}", "/p%d" % i, "navigation") for i, t in enumerate(times)]
    random.Random(3).shuffle(rows)
    path = work_path(spark, "shuffled")
    spark.createDataFrame(rows, "user_id int, timestamp long, event_id long, utm_source string, pathname string, event_type string").write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path).withColumn("event_time", ingest.event_time(F.col("timestamp")))
    out = work_path(spark, "sessions")
    ingest.append(ss.stream_sessions(stream), out, work_path(spark, "p")).awaitTermination()
    got = sorted((r["events"], r["utm_source"], r["exit_page"], r["page_depth"]) for r in spark.read.parquet(out).collect())
    assert got == [(2, "src3", "/p4", 2), (3, "src0", "/p2", 3)]  # the last one is still open


def test_spans_are_those_of_the_sessions(spark):
    r = random.Random(4)
    rows = [(u, 1_700_000_000_000 + r.randrange(0, 6 * 3_600_000), i, "s", "/p", "click") for i, u in enumerate([1, 2, 3, None] * 30)]
    path = work_path(spark, "spanned")
    spark.createDataFrame(rows, "user_id int, timestamp long, event_id long, utm_source string, pathname string, event_type string").write.parquet(path)
    found = []
    for name, closing in (("whole", ss.stream_sessions), ("spans", ss.session_spans)):
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withColumn("event_time", ingest.event_time(F.col("timestamp")))
        out = closing(stream)
        target = work_path(spark, name)
        ingest.append(out, target, work_path(spark, f"{name}-p")).awaitTermination()
        found.append(sorted(map(repr, spark.read.parquet(target).select("user_id", "started_at", "ended_at").collect())))
    assert out.columns == ["user_id", "started_at", "ended_at"]
    assert found[0] == found[1] and len(found[0]) > 5


def test_batch_form(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 3)], "event_id string, n int")
    assert ingest.once_batch(df).count() == 3
