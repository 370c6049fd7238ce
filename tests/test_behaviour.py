from helpers import events
from pyspark.sql import functions as F

from pathloom.operators import behaviour as b
from pathloom.operators.sessions import sessionize


def clicks(spark, points):
    return spark.createDataFrame([("s", t, i, float(x), float(y)) for i, (t, x, y) in enumerate(points)],
                                 "session_id string, timestamp long, event_id long, x double, y double")


def test_rage_click(spark):
    out = b.rage_clicks(clicks(spark, [(100, 200, 300), (200, 204, 297), (300, 197, 303)])).collect()
    assert [(r["timestamp"], r["click_count"]) for r in out] == [(300, 3)]


def test_rage_click_pauses(spark):
    assert b.rage_clicks(clicks(spark, [(100 * i, 5, 5) for i in range(6)])).count() == 1


def test_rage_click_needs_one_place(spark):
    assert b.rage_clicks(clicks(spark, [(0, 0, 0), (100, 50, 0), (200, 0, 0)])).count() == 0


def test_first_click(spark):
    rows = [(0, "session_start"), (1500, "click"), (1700, "click"), (3000, "navigation"), (3100, "click")]
    out = b.time_to_first_click(events(spark, rows)).collect()
    assert sorted((r["visit"], r["duration_ms"]) for r in out) == [(1, 1500), (2, 100)]


def test_tab_away(spark):
    out = b.tab_away(events(spark, [(0, "tab_exit"), (4000, "tab_return"), (5000, "tab_return")])).collect()
    assert sorted((r["timestamp"], r["tab_exit_duration_ms"]) for r in out) == [(4000, 4000), (5000, None)]


def test_debounce(spark):
    df = spark.createDataFrame([("s", t, i, "q", n) for i, (t, n) in enumerate([(0, 1), (100, 2), (150, 0), (1000, 3)])],
                               "session_id string, timestamp long, event_id long, field string, length int")
    assert sorted(r["event_id"] for r in b.debounce_last(df, "field", "length").collect()) == [1, 3]


def test_cart_never_below_zero(spark):
    out = b.cart_abandonment(events(spark, [(0, "remove_from_cart"), (1, "add_to_cart"), (2, "session_end")])).collect()
    assert [r["cart_item_count"] for r in out] == [1]


def test_purchase_empties_the_cart(spark):
    assert b.cart_abandonment(events(spark, [(0, "add_to_cart"), (1, "add_to_cart"), (2, "purchase_click")])).count() == 0


def test_milestones(spark):
    rows = [(i, "scroll_depth", {"depth_pct": float(d)}) for i, d in enumerate([0, 30, 55, 20, 60])]
    df = events(spark, rows).withColumn("depth", F.col("p.depth_pct"))
    out = b.milestones(df, "depth", [25, 50, 75, 100], ["session_id"]).collect()
    assert sorted((r["milestone"], r["timestamp"]) for r in out) == [(25, 1), (50, 2)]


def test_inactivity(spark):
    out = b.inactivity_spans(events(spark, [(0, "click"), (9_999, "click"), (25_000, "click"), (40_000, "session_end")])).collect()
    assert sorted((r["inactivity_start_time"], r["inactivity_duration"]) for r in out) == [(19_999, 5_001), (35_000, 5_000)]


def test_timeout_edge(spark):
    ttl = 30 * 60 * 1000
    df = spark.createDataFrame([(1, 0, 0), (1, ttl - 1, 1), (1, 2 * ttl - 1, 2)], "user_id int, timestamp long, event_id long")
    assert [r["session_no"] for r in sessionize(df).orderBy("event_id").collect()] == [1, 1, 2]


def test_sessions_do_not_depend_on_row_order(spark):
    rows = [(i % 3, (i * 7919) % 5_000_000, i) for i in range(300)]
    schema = "user_id int, timestamp long, event_id long"
    a = sessionize(spark.createDataFrame(rows, schema)).select("event_id", "session_id", "event_seq")
    z = sessionize(spark.createDataFrame(rows[::-1], schema).repartition(5)).select("event_id", "session_id", "event_seq")
    assert sorted(a.collect()) == sorted(z.collect())


def test_intents(spark):
    rows = [(0, "cart_intent"), (100, "cart_intent"), (150, "add_to_cart_success"), (160, "cart_action_error"),
            (200, "wishlist_intent"), (9000, "add_to_wishlist_success"), (9500, "cart_intent")]
    out = b.resolve_intents(events(spark, rows), within_ms=1000).collect()
    assert sorted((r["timestamp"], r["outcome"], r["wait_ms"]) for r in out) == [
        (0, None, None), (100, "add_to_cart_success", 50), (200, None, None), (9500, None, None)]


def test_subsection_dwell(spark):
    rows = [(0, "subsection_exit", {"subsection_id": "a"}), (10, "subsection_enter", {"subsection_id": "a"}),
            (20, "subsection_enter", {"subsection_id": "b"}), (70, "subsection_exit", {"subsection_id": "a"}),
            (80, "navigation", {}), (90, "subsection_exit", {"subsection_id": "b"})]
    assert [(r["subsection_id"], r["dwell_ms"]) for r in b.subsection_dwell(events(spark, rows)).collect()] == [("a", 60)]


def test_transitions_and_revisits(spark):
    rows = [(i, "section_enter", {"section": s}) for i, s in enumerate(["a", "b", "b", "a"])]
    df = events(spark, rows)
    assert sorted((r["from"], r["to"]) for r in b.section_transitions(df).collect()) == [("a", "b"), ("b", "a")]
    assert sorted((r["section"], r["count"]) for r in b.section_revisits(df).collect()) == [("a", 2), ("b", 2)]


def test_repeated_navigation(spark):
    rows = [(0, "navigation", {}, "/a"), (60, "navigation", {}, "/a"), (120, "navigation", {}, "/a"), (130, "navigation", {}, "/b")]
    assert sorted(r["timestamp"] for r in b.suppress_repeats(events(spark, rows)).collect()) == [0, 120, 130]
