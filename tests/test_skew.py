"""One user owns a third of all events: every ordered operator gives the same rows in ranges as at once."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions.payload import parse_payload
from pathloom.operators import behaviour as b, external as ext, quality as q, reports as rp, sequences as sq, sessions as ss, vocab as vo
from pathloom.plans.fixtures import DAY_MS, raw_clicks

SF = "/root/testdata/sf0.001"
KEYS = ["user_id", "session_id"]


@pytest.fixture(scope="module")
def skewed(spark):
    raw = raw_clicks(spark, SF).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    return raw.withColumn("p", parse_payload(F.col("data"))).cache()


@pytest.fixture(scope="module")
def clicks(skewed):
    return ss.sessionize(skewed, ttl_ms=30 * DAY_MS).cache()


def xy(df):
    return df.withColumns({"x": F.col("p.x"), "y": F.col("value"), "depth": F.col("p.depth_pct"), "field": F.col("p.input_name")})


H = 3_600_000


def external(c):
    rows = c.select(
        F.col("session_id").alias("session_id_hash"), F.when(F.col("k") % 3 == 0, "pageview").otherwise("event_product").alias("event_type"),
        F.when(F.col("k") % 3 > 0, F.element_at(F.array(*map(F.lit, ("detail", "add", "remove"))), F.col("k") % 3 + 1)).alias("product_action"),
        F.col("timestamp").alias(ext.TIME), "event_id", "page_url",
    )
    return ext.external_sequences(rows, [ext.TIME, "event_id"])


def remapped(c):
    long = sq.semantic_sequences(c, KEYS)
    return sq.remap_tokens(long, long.where(F.col("token").startswith("PRODUCT")), {"HOME|ENTER_HOME|NONE": "PRODUCT|VIEW_PRODUCT|NONE"}, KEYS)[0]


OPERATORS = {
    "sessionize": lambda c: ss.sessionize(c.drop("session_id", "session_no", "event_seq", "inter_event_gap", "is_new_session", "is_returning"), ttl_ms=H).select("event_id", "session_id", "event_seq", "inter_event_gap"),
    "event_seq": lambda c: ss.event_seq(c.drop("event_seq"), KEYS).select("event_id", "event_seq"),
    "first_click": lambda c: b.time_to_first_click(c, KEYS),
    "inactivity": lambda c: b.inactivity_spans(c, KEYS),
    "cart": lambda c: b.cart_state(c, KEYS).select("event_id", "cart_count"),
    "revisits": lambda c: b.section_revisits(c, KEYS).select("event_id", "count"),
    "transitions": lambda c: b.section_transitions(c, KEYS).select("event_id", "from", "to"),
    "dwell": lambda c: b.subsection_dwell(c, KEYS).select("event_id", "dwell_ms"),
    "tab": lambda c: b.tab_away(c, KEYS).select("event_id", "tab_exit_duration_ms"),
    "directions": lambda c: b.direction_changes(xy(c), "y", KEYS).select("event_id", "from", "to"),
    "debounce": lambda c: b.debounce_last(xy(c), "field", "k", KEYS, H).select("event_id"),
    "pages": lambda c: b.page_dwell(c, KEYS),
    "options": lambda c: b.option_changes(c, KEYS).select("event_id", "change_count"),
    "motion": lambda c: b.motion_summary(xy(c), KEYS, H),
    "rage": lambda c: b.rage_clicks(xy(c), KEYS, 6 * H, 400, 3, 12 * H).select("event_id", "click_count"),
    "thin": lambda c: b.thin_by_delta(xy(c), "depth", KEYS).select("event_id"),
    "speed": lambda c: b.throttled_speed(xy(c), "y", KEYS, 6 * H).select("event_id", "duration_ms"),
    "repeats": lambda c: b.suppress_repeats(c, KEYS, 8 * H).select("event_id"),
    "intents": lambda c: b.resolve_intents(c, {"add_to_cart": ["purchase_click"]}, KEYS),
    "exits": lambda c: rp.exit_places(c, KEYS),
    "tokens": lambda c: sq.semantic_tokens(c, KEYS).select("event_id", "token", "section"),
    "sequences": lambda c: sq.semantic_sequences(c, KEYS),
    "vocabulary": lambda c: vo.build_vocab(sq.event_sequences(c, KEYS)),
    "gap": lambda c: ss.inter_event_gap(c.drop("inter_event_gap"), KEYS).select("event_id", "inter_event_gap"),
    "paths": lambda c: b.nav_paths(c, KEYS).select("event_id", "page_depth", "previous"),
    "context": lambda c: ss.carry_context(c, {"place": F.col("p.section"), "source": F.col("utm_source")}, KEYS).select("event_id", "place", "source"),
    "remap": lambda c: remapped(c),
    "external": lambda c: external(c).withColumn("sequence", F.array_join("sequence", " ")),
    "undersample": lambda c: ext.undersample(c.select("event_id", (F.col("user_id") % 2).cast("string").alias("kind")), "kind", "0", "event_id", 1, 7),
    "auc": lambda c: q.auc_metrics(c.select((F.col("k") % 2).alias("y_true"), (F.col("event_id") / 1_000).alias("y_prob"))),
    "labelled": lambda c: ext.labelled_sessions(
        c.select(F.col("session_id").alias("session_id_hash"), "event_type", F.lit("add").alias("product_action"), F.col("timestamp").alias(ext.TIME), "event_id"),
        [ext.TIME, "event_id"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_same_rows_with_a_hot_user(clicks, hot, name):
    run = OPERATORS[name]
    at_once = sorted(map(repr, run(clicks).collect()))
    hot(100)
    assert sorted(map(repr, run(clicks).collect())) == at_once
    assert at_once
