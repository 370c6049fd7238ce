"""What tokens and session vectors cost: plain words, short generated methods, no shuffle per token."""

from pyspark.sql import functions as F

from pathloom.functions.pages import AREAS, PAGE_RULES, TEMPLATE_PATHS
from pathloom.functions.rules import first_match, pattern_of
from pathloom.operators import clusters as cl, sequences as sq
from pathloom.session import METHOD_CONF
from tests.helpers import events


def test_plain_words_are_found_as_expressions_find_them(spark):
    texts = ["", "user_review", "배송정보", "size", "할인", "/order/basket.html", "/board/x후기", "/index.html", "/", None, "photo detail"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (AREAS, PAGE_RULES["compat"], PAGE_RULES["fixed"], TEMPLATE_PATHS):
        slow = F.coalesce(*(F.when(F.col("t").rlike(pattern_of(w)), F.lit(v)) for v, w in rules), F.lit("-"))
        for fast in (first_match("t", rules, "-"), first_match(F.col("t"), rules, "-")):
            assert rows.where(~fast.eqNullSafe(slow)).count() == 0
    plan = rows.select(first_match("t", AREAS))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan


def test_methods_of_the_token_step_stay_compilable(spark):
    spark.conf.unset(METHOD_CONF)
    rows = events(spark, [(1, "click", {"click_text": "review 12"}), (2, "hover", {"hover_text": "size"}), (3, "click", {"section": "gallery"})])
    rows = rows.withColumn("page_url", F.lit(None).cast("string"))
    out = [r.token.split("|")[1] for r in sq.semantic_sequences(rows).orderBy("pos").collect()]
    assert out == ["VIEW_REVIEW", "CHECK_SIZE", "CLICK_ELEMENT"]
    assert spark.conf.get(METHOD_CONF) == "8000"


def test_session_vectors_of_short_and_long_sessions(spark, monkeypatch):
    monkeypatch.setattr(sq.in_parts, "__defaults__", ("pos", 3))
    words = {("u", "a"): "xyxyxyx", ("u", "b"): "xy", (None, "c"): "yyyxx"}
    long = spark.createDataFrame([(*k, i + 1, t) for k, ts in words.items() for i, t in enumerate(ts)], "user_id string, session_id string, pos long, token string")
    out = cl.w2v_vectors(long, ["user_id", "session_id"], size=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "token" not in plan  # vectors are never joined to counted tokens
    v = {(r.user_id, r.session_id): r.vector for r in out.collect()}
    assert set(v) == set(words) and out.count() == 3
    # means of x and y: from two sessions follow both words, and the third session
    x = [7 * a - 6 * b for a, b in zip(v["u", "a"], v["u", "b"])]
    y = [2 * b - a for a, b in zip(x, v["u", "b"])]
    assert all(abs((2 * a + 3 * b) / 5 - c) < 1e-6 for a, b, c in zip(x, y, v[None, "c"]))
