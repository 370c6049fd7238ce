"""Plain and range-wise evaluation against loops over sorted lists."""

import pytest
from helpers import by_key, skewed
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators import ordered as o

KEYS, ORDER = ["key"], ["timestamp", "event_id"]
SCHEMA = "key int, timestamp long, event_id long, name string, value int"


def expected(rows):
    out = {}
    for group in by_key(rows).values():
        names = [r[3] for r in group]
        values = [r[4] for r in group]
        for i, row in enumerate(group):
            before = [x for x in names[:i] if x is not None]
            after = [x for x in names[i + 1 :] if x is not None]
            upto = [x for x in names[: i + 1] if x is not None]
            out[row[2]] = (
                names[i - 1] if i else None,
                names[i + 1] if i + 1 < len(names) else None,
                upto[-1] if upto else None,
                before[-1] if before else None,
                after[0] if after else None,
                sum(values[: i + 1]),
                min(values[: i + 1]),
                max(values[: i + 1]),
            )
    return out


@pytest.mark.parametrize("bound", [1_000_000, 25])
def test_steps(spark, hot, bound):
    hot(bound)
    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA)
    name, value = F.col("name"), F.col("value")
    got = o.ordered(
        df, KEYS, ORDER,
        lambda k: k.add(
            a=o.lag(name), b=o.lead(name), c=o.known(name), d=o.prev_known(name), e=o.next_known(name),
            f=o.running_sum(value), g=o.running_min(value), h=o.running_max(value),
        ).df,
    )
    assert {r["event_id"]: tuple(r[c] for c in "abcdefgh") for r in got.collect()} == expected(rows)


@pytest.mark.parametrize("bound", [1_000_000, 25])
def test_split_by_nullable_column(spark, hot, bound):
    hot(bound)
    rows = skewed(11)
    got = o.ordered(
        spark.createDataFrame(rows, SCHEMA), KEYS, ORDER, lambda k: k.add(by=["name"], n=o.running_sum(F.lit(1))).df
    )
    seen, want = {}, {}
    for group in by_key(rows).values():
        for r in group:
            seen[r[0], r[3]] = seen.get((r[0], r[3]), 0) + 1
            want[r[2]] = seen[r[0], r[3]]
    assert {r["event_id"]: r["n"] for r in got.collect()} == want


def test_no_range_exceeds_its_share(spark, hot):
    hot(50)
    df = spark.createDataFrame([(0, 5, i, "a", 1) for i in range(2000)], SCHEMA)  # one key, one instant
    chunks = o.ranges(df, KEYS, ORDER, 2000)
    assert chunks.groupBy(o.CHUNK).count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize("bound", [1_000_000, 25])
def test_fold(spark, hot, bound):
    hot(bound)

    def step(state, row):
        """Keep a value that differs by 2 or more from the last kept one."""
        event_id, value = row
        if "last" not in state or abs(state["last"] - value) >= 2:
            return {"last": int(value)}, [(int(event_id),)]
        return state, []

    rows = skewed(3)
    got = o.fold(
        spark.createDataFrame(rows, SCHEMA), KEYS, ORDER, ["event_id", "value"], step,
        T.StructType([T.StructField("kept", T.LongType())]),
    )
    want = set()
    for group in by_key(rows).values():
        last = None
        for r in group:
            if last is None or abs(last - r[4]) >= 2:
                last = r[4]
                want.add(r[2])
    assert {r["kept"] for r in got.collect()} == want


@pytest.mark.parametrize("bound", [1_000_000, 40])
def test_numbered(spark, hot, bound):
    hot(bound)
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("x"))
    assert sorted((r["x"], r["n"]) for r in o.numbered(df, ["x"], "n").collect()) == [(i, i + 1) for i in range(300)]
