"""Folds walk only stretches in which something can happen, and give the same rows as a walk over everything."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators import behaviour as b, ordered
from pathloom.operators.ordered import fold

KEYS = ["user"]


def made(seed, n=700):
    r, rows, at = random.Random(seed), [], {}
    for i in range(n):
        user = r.choice(["a", "a", "a", "b", "c", None])
        at[user] = at.get(user, 0) + r.choice([0, 20, 60, 100, 150, 400, 499, 500, 999, 1_000, 1_001, 5_000])
        y = r.choice([None, float(r.randrange(0, 60)), float(r.randrange(0, 400)), 5.0])
        rows.append((user, at[user], f"e{i:04d}", float(r.randrange(30)), y, r.choice(["/a", "/a", "/b", None])))
    return rows


@pytest.fixture(scope="module", params=[1, 2, 3])
def rows(spark, request):
    return spark.createDataFrame(made(request.param), "user string, timestamp long, event_id string, x double, y double, pathname string").cache()


def whole(df, values, step, fields):
    out = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("event_id", T.StringType()), *fields])
    return fold(df, KEYS, ["timestamp", "event_id"], ["timestamp", "event_id", *values], step, out)


def same(got, want, least=5):
    got, want = (sorted(map(tuple, df.select("user", "event_id").collect()), key=repr) for df in (got, want))
    assert got == want and len(got) > least


@pytest.mark.parametrize("window, cooldown", [(500, 1_000), (1_000, 200), (150, 0)])
def test_rage_clicks(rows, window, cooldown):
    clicks = rows.withColumn("y", F.coalesce("y", F.lit(0.0)))
    fields = [T.StructField(n, T.DoubleType()) for n in "xy"] + [T.StructField("n", T.LongType())]
    want = whole(clicks, ["x", "y"], b.rage_step(window, 40, 3, cooldown), fields)
    same(b.rage_clicks(clicks, KEYS, window, 40, 3, cooldown), want, 0)


@pytest.mark.parametrize("first_is_base", [True, False])
@pytest.mark.parametrize("delta", [3, 25])
def test_thin_by_delta(rows, delta, first_is_base):
    def step(state, row):
        ts, event_id, v = row
        base = state.get("base")
        if base is None and first_is_base:
            return {"base": v}, []
        if abs(v - (-1 if base is None else base)) >= delta:
            return {"base": v}, [(int(ts), event_id)]
        return state, []

    same(b.thin_by_delta(rows, "y", KEYS, delta, first_is_base), whole(rows.where("y IS NOT NULL"), ["y"], step, []))


@pytest.mark.parametrize("min_px", [0, 50])
def test_throttled_speed(rows, min_px):
    def step(state, row):
        ts, event_id, y = row
        if not state:
            return {"t": int(ts), "y": y}, []
        if ts - state["t"] < 1_000:
            return state, []
        return {"t": int(ts), "y": y}, [(int(ts), event_id)] if abs(y - state["y"]) >= min_px else []

    same(b.throttled_speed(rows, "y", KEYS, 1_000, min_px), whole(rows.where("y IS NOT NULL"), ["y"], step, []))


@pytest.mark.parametrize("within", [100, 1_000])
def test_suppress_repeats(rows, within):
    def step(state, row):
        ts, event_id, path = row
        if state and state["path"] == path and ts - state["ts"] < within:
            return state, []
        return {"path": path, "ts": int(ts)}, [(int(ts), event_id)]

    same(b.suppress_repeats(rows, KEYS, within), whole(rows, ["pathname"], step, []))


def test_quiet_stretches_do_not_reach_python(spark, monkeypatch):
    """Ten clicks, an hour apart: nothing is walked."""
    rows = spark.createDataFrame([("a", i * 3_600_000, f"e{i}", 1.0, 2.0, f"/{i}") for i in range(10)],
                                 "user string, timestamp long, event_id string, x double, y double, pathname string")
    seen = []
    real = b.fold
    monkeypatch.setattr(b, "fold", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    assert b.rage_clicks(rows, KEYS).count() == 0
    assert b.thin_by_delta(rows.withColumn("y", F.col("timestamp").cast("double")), "y", KEYS).count() == 9
    assert b.throttled_speed(rows, "y", KEYS).count() == 0
    assert b.suppress_repeats(rows, KEYS).count() == 10
    assert seen == [0, 0, 0, 0]


def test_stretches_of_small_keys_are_not_counted_again(spark, monkeypatch):
    """A stretch lies within its key, so one count of the keys is enough."""
    counted, given = [], ordered.hot_keys

    def count(df, keys):
        counted.append(list(keys))
        return given(df, keys)

    monkeypatch.setattr(ordered, "hot_keys", count)
    monkeypatch.setattr(b, "hot_keys", count, raising=False)
    rows = spark.createDataFrame([("s", 100 * i, i, 1.0, 1.0) for i in range(5)], "session_id string, timestamp long, event_id long, x double, y double")
    assert b.rage_clicks(rows, ["session_id"]).count() == 1
    assert [k for k in counted if len(k) > 1] == []
