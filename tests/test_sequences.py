import random

import pytest
from helpers import events
from pyspark.sql import functions as F

from pathloom.functions.pages import with_page
from pathloom.operators import sequences as sq


def compressed(spark, sequences, **options):
    rows = [(s, i, t) for s, seq in sequences.items() for i, t in enumerate(seq)]
    df = spark.createDataFrame(rows, "session_id string, i long, token string")
    out = {}
    for r in sq.compress(df, ["session_id"], ["i"], **options).orderBy("session_id", "pos").collect():
        out.setdefault(r["session_id"], []).append(r["token"])
    return out


def walk(tokens, window=8):
    """The definition, as a loop over a list: runs, then episodes with a list of recent intents."""
    kept = [t for i, t in enumerate(tokens) if i == 0 or tokens[i - 1] != t]
    kinds = {**dict.fromkeys(sq.FOCUS_AWAY, "away"), **{s: s for s in sq.SCROLL_NOISE}, **dict.fromkeys(sq.GENERIC_NOISE, "generic")}
    runs = []
    for t in kept:
        kind = kinds.get(t.split("|")[1])
        if runs and kind and runs[-1][0] == kind:
            runs[-1][1].append(t)
        else:
            runs.append((kind, [t]))
    short = []
    for kind, run in runs:
        page, action, _ = run[0].split("|")
        if kind is None or len(run) < 3:
            short += run
        elif kind == "away":
            short.append(f"{page}|DISTRACTED_EPISODE|REPEAT")
        else:
            short.append(run[0] if kind == "generic" else f"{page}|{action}|SCROLLED")
    out, recent, done = [], [], set()
    prefixes = ("ENTER_", "EXIT_", "START_SESSION", "ADD_CART", "CLICK_BUY", "CART_ABANDON", "RAGE_CLICK")
    for t in short:
        out.append(t)
        page, action, _ = t.split("|")
        if action.startswith(prefixes):
            recent, done = [], set()
        elif action in sq.EPISODES:
            recent.append(action)
            if len(recent) > window:
                recent.pop(0)
                done &= set(recent)
            if recent.count(action) >= 2 and action not in done:
                out.append(f"{page}|{sq.EPISODES[action]}|STRONG")
                done.add(action)
    return out


ACTIONS = [*sq.EPISODES, "TAB_OUT", "INACTIVE", "SCROLL_PRODUCT", "HOVER_ELEMENT", "CLICK_ELEMENT", "ADD_CART", "ENTER_HOME", "ZOOM_IMAGE"]
WEIGHTS = [6, 3, 3, 3, 2, 2, 2, 2, 2, 0.3, 0.2, 1]


@pytest.mark.parametrize("bound", [1_000_000, 60])
def test_compression_equals_a_walk(spark, hot, bound):
    hot(bound)
    r = random.Random(5)
    lengths = {"hot": 400, **{f"s{i}": r.randrange(1, 50) for i in range(15)}}
    data = {
        s: [f"{r.choice(['HOME', 'PRODUCT'])}|{a}|NONE" for a in r.choices(ACTIONS, WEIGHTS, k=n)] for s, n in lengths.items()
    }
    assert compressed(spark, data) == {s: walk(t) for s, t in data.items()}


def test_runs(spark):
    away = ["HOME|TAB_OUT|NONE", "PRODUCT|INACTIVE|NONE", "HOME|TAB_RETURN|NONE"]
    got = compressed(spark, {"a": away, "b": away[:2], "c": ["P|SCROLL_PRODUCT|SCROLL_LOW", "P|SCROLL_PRODUCT|SCROLL_MID", "P|SCROLL_PRODUCT|SCROLL_LOW"]})
    assert got == {"a": ["HOME|DISTRACTED_EPISODE|REPEAT"], "b": away[:2], "c": ["P|SCROLL_PRODUCT|SCROLLED"]}


def test_episode_and_reset(spark):
    price = "PRODUCT|CHECK_PRICE|NONE"
    got = compressed(spark, {"a": [price, "PRODUCT|SCROLL_PRODUCT|SCROLL_LOW", price, "X|ZOOM_IMAGE|NONE", price],
                             "b": [price, "CART|ENTER_CART|NONE", price]})
    assert got["a"].count("PRODUCT|PRICE_REVIEW_EPISODE|STRONG") == 1
    assert got["a"][3] == "PRODUCT|PRICE_REVIEW_EPISODE|STRONG"
    assert got["b"] == [price, "CART|ENTER_CART|NONE", price]


def test_section_survives_the_exit_of_another(spark):
    rows = [(0, "section_enter", {"section": "review"}), (1, "section_exit", {"section": "price"}), (2, "click", {}),
            (3, "section_exit", {"section": "review"}), (4, "click", {})]
    df = events(spark, [(t, k, p, "/product/1") for t, k, p in rows]).withColumn("page_url", F.lit(None).cast("string"))
    got = {r["event_id"]: (r["section"], r["token"]) for r in sq.semantic_tokens(df).collect()}
    assert got[2] == ("review", "PRODUCT|VIEW_REVIEW|NONE")
    assert got[4] == (None, "PRODUCT|CLICK_ELEMENT|NONE")


def test_unmapped_events_can_be_kept(spark):
    df = events(spark, [(0, "screen_resize", {}, "/cart"), (1, "section_exit", {}, "/cart"), (2, "scroll_stop", {}, "/cart")])
    df = df.withColumn("page_url", F.lit(None).cast("string"))
    assert sq.semantic_tokens(df).count() == 0
    assert [r["token"] for r in sq.semantic_tokens(df, unknown=True).collect()] == ["CART|UNKNOWN_EVENT|screen_resize"]


def test_unknown_share(spark):
    rows = [("half", i, t) for i, t in enumerate(["UNKNOWN|A|NONE", "UNKNOWN|B|NONE", "HOME|A|NONE", "HOME|B|NONE"])]
    rows += [("most", i, t) for i, t in enumerate(["UNKNOWN|A|NONE", "UNKNOWN|B|NONE", "UNKNOWN|C|NONE", "HOME|B|NONE"])]
    long = spark.createDataFrame(rows, "session_id string, pos long, token string")
    ev = spark.createDataFrame([(s, 0) for s in ("half", "most", "empty")], "session_id string, timestamp long")
    kept = {r["session_id"]: r["length"] for r in sq.sequence_summary(ev, long).collect()}
    assert kept == {"half": 4, "empty": 0}


def test_pages_of_a_hosted_shop(spark):
    paths = {
        "/": ("HOME", "HOME"),
        "/category/아우터/42/": ("CATEGORY", "CATEGORY"),
        "/product/코트/45/category/1/display/6/": ("PRODUCT", "PRODUCT"),
        "/order/basket.html": ("CHECKOUT", "CART"),
        "/board/상품-사용후기/4/": ("PRODUCT", "REVIEW"),
        "/board/%EC%83%81%ED%92%88-%EC%82%AC%EC%9A%A9%ED%9B%84%EA%B8%B0/4/": ("UNKNOWN", "REVIEW"),
        "/product/image_zoom2.html?product_no=45": ("PRODUCT", "PRODUCT"),
        "/myshop/index.html": ("UNKNOWN", "UNKNOWN"),
        "/member/login.html": ("UNKNOWN", "UNKNOWN"),
        "https://x.example/item?a=1#b": ("PRODUCT", "PRODUCT"),
        "/x?goods_id=3": ("PRODUCT", "PRODUCT"),
    }
    df = spark.createDataFrame([(p, None) for p in paths], "pathname string, page_url string")
    df = with_page(with_page(df, "a"), "b", "fixed")
    assert {r["pathname"]: (r["a"], r["b"]) for r in df.collect()} == paths


def test_parts_hold_everything(spark):
    long = spark.range(1, 101).select(F.lit("s").alias("session_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("token"))
    parts = sorted(sq.in_parts(long, ["session_id"], "token", rows=30).collect(), key=lambda r: r["part"])
    assert [len(r["values"]) for r in parts] == [30, 30, 30, 10]
    assert [t for r in parts for t in r["values"]] == [str(i) for i in range(1, 101)]
