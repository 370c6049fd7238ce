"""Sessions while they are open: several batches, shuffled, against the batch operators."""

import random

import pytest
from helpers import EVENT
from pyspark.sql import functions as F

from pathloom.functions.payload import PAYLOAD
from pathloom.operators import behaviour as b
from pathloom.session import work_path
from pathloom.streaming import ingest, intents, late, live

T0 = 1_700_000_000_000
TTL = 30 * 60_000
KINDS = [
    "navigation", "click", "click", "click", "add_to_cart", "remove_from_cart", "purchase_click", "section_enter", "section_enter",
    "option_select", "option_change", "option_select", "option_change", "inactivity", "session_end", "scroll_stop", "session_start",
]
SCHEMA = EVENT.replace("session_id string", "user_id int, utm_source string")


def made(seed, n=240, users=3):
    """(user, utm, ts, id, type, path, payload); short and long gaps, equal times, three to five sessions a user."""
    r, rows, at = random.Random(seed), [], dict.fromkeys(range(users), T0)
    for i in range(n):
        user = r.randrange(users)
        at[user] += r.choice([0, 100, 150, 200, 4_000, 9_999, 10_000, 10_001, 60_000, TTL - 1, TTL])
        kind = r.choice(KINDS)
        p = {f.name: None for f in PAYLOAD.fields}
        p.update(section=r.choice(["a", "b", None]), option_name=r.choice(["size", None]), option_value=r.choice(["S", "M", None]))
        p.update(position=r.choice([None, 5.0, 70.0]), x=float(r.randrange(40)), y=None if r.random() < 0.5 else float(r.randrange(40)))
        if r.random() < 0.3:
            p["click_position"] = {"x": float(r.randrange(20)), "y": 3.0}
        rows.append((user, r.choice(["s1", None]), at[user], i, kind, f"/p{r.randrange(5)}", p))
    p = {f.name: None for f in PAYLOAD.fields} | {"click_position": {"x": 5.0, "y": 5.0}, "x": 900.0}
    rows += [(0, None, at[0] + 50 * k, n + k, "click", "/burst", p) for k in range(7)]
    return rows


def timed(df):
    return df.withColumn("event_time", ingest.event_time(F.col("timestamp")))


def run(spark, rows, schema, stream, batches=4, seed=5):
    """Rows delivered in ``batches`` by time, shuffled within each."""
    path, out, r = work_path(spark, "in"), work_path(spark, "out"), random.Random(seed)
    rows = sorted(rows, key=lambda x: x[2])
    size = -(-len(rows) // batches)
    checkpoint = work_path(spark, "progress")
    for i in range(0, len(rows), size):
        some = rows[i : i + size]
        r.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
        ingest.append(stream(timed(spark.readStream.schema(schema).parquet(path))), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def lived(spark):
    rows = made(1)
    end = max(r[2] for r in rows)
    nothing = {f.name: None for f in PAYLOAD.fields}
    rows += [(99, None, end + 3 * TTL, 1_000, "navigation", "/", nothing)]  # another user moves the watermark beyond all timeouts
    got = run(spark, rows, SCHEMA, lambda e: live.live_sessions(live.live_rows(e), delay="1 second"))
    batch = spark.createDataFrame([r for r in rows if r[0] != 99], SCHEMA)
    from pathloom.operators.sessions import sessionize

    sessions = sessionize(batch).cache()
    return got.where("user_id <> 99").cache(), sessions


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_running_states_equal_the_batch_operators(spark, lived):
    got, s = lived
    carts = b.cart_state(s)
    assert pairs(got.where("kind = 'cart'"), "event_id", "number") == pairs(carts, "event_id", "cart_count")
    revisits = b.section_revisits(s)
    assert pairs(got.where("kind = 'revisit'"), "event_id", "name", "number") == pairs(revisits, "event_id", "section", "count")
    options = b.option_changes(s)
    assert pairs(got.where("kind = 'option'"), "event_id", "name", "number") == pairs(options, "event_id", "option_name", "change_count")
    x, y = b.click_point(F.col("p"))
    rage = b.rage_clicks(s.where("event_type = 'click'").withColumns({"x": x, "y": y}))
    assert pairs(got.where("kind = 'rage_click'"), "event_id", "number") == pairs(rage, "event_id", "click_count")
    first = b.time_to_first_click(s)
    assert pairs(got.where("kind = 'first_click'"), "number", "duration_ms") == pairs(first, "visit", "duration_ms")
    assert all(df.count() for df in (carts, revisits, options, rage, first))


def test_silences_equal_the_batch_operator(lived):
    got, s = lived
    spans = b.inactivity_spans(s)
    assert pairs(got.where("kind = 'inactivity'"), "timestamp", "duration_ms") == pairs(spans, "inactivity_start_time", "inactivity_duration")
    assert spans.count()


def test_exit_records_equal_the_batch_operators(lived):
    got, s = lived
    last = b.page_dwell(s).groupBy("session_id").agg(F.max_by("page_dwell_time", "visit").alias("dwell"))
    want = b.exit_records(s).join(last, "session_id")
    columns = ("name", "timestamp", "depth", "bounce", "scroll_y", "duration_ms")
    wanted = ("exit_page", "last_event_time", "page_depth", "bounce_flag", "last_scroll_y", "dwell")
    assert pairs(got.where("kind = 'session_end'"), *columns) == pairs(want, *wanted)
    pages = b.page_dwell(s)
    assert pairs(got.where("kind = 'page'"), "name", "duration_ms") == pairs(pages, "pathname", "page_dwell_time")
    assert got.where("kind = 'session_start'").count() == want.count()


def test_timers_need_no_further_event(spark):
    """After the first batch user 1 is silent; user 2 moves the watermark over the silence, later over the timeout."""
    none = {f.name: None for f in PAYLOAD.fields}

    def click(user, ts, i):
        return (user, None, T0 + ts, i, "add_to_cart", "/", none)

    path, out, checkpoint = (work_path(spark, n) for n in ("in", "out", "progress"))
    seen = []
    for rows in ([click(1, 0, 0), click(1, 5_000, 1)], [click(2, 16_000, 2)], [click(2, 5_000 + TTL, 3)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = timed(spark.readStream.schema(SCHEMA).parquet(path))
        ingest.append(live.live_sessions(live.live_rows(stream), delay="0 seconds"), out, checkpoint).awaitTermination()
        seen.append(pairs(spark.read.parquet(out).where("user_id = 1"), "kind", (F.col("timestamp") - T0).alias("at"), "number"))
    assert seen[0] == [("cart", 0, 1), ("cart", 5_000, 2), ("session_start", 0, None)]  # before any session has closed
    assert seen[1] == sorted([*seen[0], ("idle", 15_000, None)], key=repr)
    assert [r[0] for r in seen[2]].count("session_end") == 1
    assert [r for r in seen[2] if r[0] == "idle"] == [("idle", 15_000, None)]


def test_motion_over_batches(spark):
    r, rows, ts = random.Random(3), [], T0
    for i in range(120):
        ts += r.choice([0, 50, 700, 2_000, 5_000, TTL])
        rows.append((i % 2, None, ts, i, float(r.randrange(100)), None if r.random() < 0.1 else float(r.randrange(100))))
    rows.append((9, None, ts + 2 * TTL, 999, 0.0, 0.0))
    schema = "user_id int, utm_source string, timestamp long, event_id long, x double, y double"
    got = run(spark, rows, schema, lambda e: live.live_motion(e.drop("utm_source"), delay="1 second"), 3)
    known = [x for x in rows if x[0] != 9]
    want = {}
    by_user = {}
    for user, _, t, i, x, y in known:
        by_user.setdefault(user, []).append((t, i, x, y))
    for user, ps in by_user.items():
        last, towards, before = None, None, None
        for t, i, x, y in sorted(ps, key=lambda p: p[:2]):
            if before is not None and t - before >= TTL:
                last, towards = None, None
            cell = want.setdefault((user, t - t % 2_000), [0.0, 0])
            now = None
            if last and None not in (x, y, *last):
                dx, dy = x - last[0], y - last[1]
                cell[0] += (dx * dx + dy * dy) ** 0.5
                now = ((dx > 0) - (dx < 0), (dy > 0) - (dy < 0))
                cell[1] += towards is not None and towards != now
            last, towards, before = (x, y), now, t
    want = sorted((u, w, int(d + 0.5), n) for (u, w), (d, n) in want.items() if int(d + 0.5) > 0)
    assert sorted(map(tuple, got.where("user_id <> 9").select("user_id", "window_start", "distance_px", "jitter_count").collect())) == want
    assert len(want) > 10


def test_intents_expire_without_outcome(spark):
    def e(ts, i, kind, user=1):
        return (user, None, T0 + ts, i, kind, "/", None)

    rows = [
        e(0, 0, "cart_intent"), e(1_000, 1, "cart_intent"), e(1_500, 2, "add_to_cart_success"), e(1_600, 3, "add_to_cart_success"),
        e(9_000, 4, "wishlist_intent"), e(14_000, 5, "wishlist_login_required"), e(20_000, 6, "cart_intent"), e(90_000, 7, "click"),
    ]
    stored = run(spark, rows, SCHEMA, lambda s: intents.intent_pairs(s, 5_000, delay="0 seconds"), 2)
    got = sorted(map(tuple, intents.resolved(stored).select("event_id", "outcome", "wait_ms").collect()))
    assert got == [(0, None, None), (1, "add_to_cart_success", 500), (4, None, None), (6, None, None)]


def test_late_rows_are_kept_and_merged(spark):
    schema = "user_id int, utm_source string, timestamp long, event_id long, event_type string, pathname string"
    r = random.Random(8)
    rows = [(i % 3, f"s{i}", T0 + r.randrange(40) * 600_000, i, "navigation", f"/p{i}") for i in range(60)]
    first, second = [x for x in rows if x[3] % 4], [x for x in rows if not x[3] % 4]
    path, out, checkpoint = (work_path(spark, n) for n in ("in", "out", "progress"))
    for some in (first, second):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
        late.split(spark.readStream.schema(schema).parquet(path), out, checkpoint, delay_ms=0).awaitTermination()
    kept = late.stored(spark, out)
    newest = max(x[2] for x in first)
    assert sorted(x[0] for x in kept.where("late").select("event_id").collect()) == sorted(x[3] for x in second if x[2] <= newest)
    assert kept.count() == len(rows)
    columns = ("user_id", "events", "started", "ended", "first", "last", "page_depth", "interactions")
    before = late.merge(late.as_sessions(kept.where("not late").drop("late", "batch")))
    after = late.correct(before, kept.where("late").drop("late", "batch"))
    assert pairs(after, *columns) == pairs(late.merge(late.as_sessions(spark.createDataFrame(rows, schema))), *columns)
    assert pairs(before, *columns) != pairs(after, *columns)


def test_tail_resumes(spark):
    path, out, checkpoint = (work_path(spark, n) for n in ("in", "out", "progress"))
    schema = "event_id long, event_type string"
    for part in ([(1, "a"), (2, None)], [(3, "b")], []):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        ingest.follow(spark, path, spark.read.parquet(path).schema, out, checkpoint, files_per_batch=1).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("event_id", "batch").collect())) == [(1, 0), (3, 1)]


def test_click_points(spark):
    rows = [({"x": 1.0, "y": 2.0}, 5.0, 6.0), ({"x": None, "y": 2.0}, 5.0, 6.0), (None, 5.0, None), (None, None, None)]
    df = spark.createDataFrame([(r,) for r in rows], "p struct<click_position:struct<x:double,y:double>,x:double,y:double>")
    assert [tuple(r) for r in df.select(*b.click_point(F.col("p"))).collect()] == [(1.0, 2.0), (5.0, 2.0), (5.0, 0.0), (0.0, 0.0)]
