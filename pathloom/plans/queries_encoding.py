"""Registered queries: vocabularies, encodings, external clickstream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.operators import external as ext, vocab as vo
from pathloom.operators.external import external_sequences as build_external
from pathloom.plans.fixtures import Clicks, clicks_sql
from pathloom.plans.queries_sequences import KEYS, SEQ, sequences_of
from pathloom.plans.registry import query
from pathloom.session import cut


def vocab_sql(offset: int = 4, having: str = "") -> str:
    return f"""voc AS (SELECT token, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, token) + {offset - 1} AS id
    FROM seq GROUP BY token {having})"""


def vocab_of(spark, sf):
    """Sequences, written once because the vocabulary and its use both read them, and the vocabulary."""
    c, long = sequences_of(spark, sf)
    long = cut(long)
    return c, long, vo.build_vocab(long)


@query("token_frequencies", f"{SEQ} SELECT token, count(*) AS freq FROM seq GROUP BY 1")
def token_frequencies(spark, sf):
    return vo.token_frequencies(sequences_of(spark, sf)[1])


@query("build_vocab", f"""{SEQ}, {vocab_sql()} SELECT token, id, freq FROM voc
    UNION ALL VALUES ('[PAD]', 0, NULL), ('[UNK]', 1, NULL), ('[CLS]', 2, NULL), ('[MASK]', 3, NULL)""")
def build_vocab(spark, sf):
    return vocab_of(spark, sf)[2]


@query("build_vocab_capped", f"""{SEQ}, {vocab_sql(4, 'HAVING count(*) >= 5')} SELECT token, id, freq FROM voc WHERE id < 40
    UNION ALL VALUES ('[PAD]', 0, NULL), ('[CLS]', 1, NULL), ('[MASK]', 2, NULL), ('[UNK]', 3, NULL)""")
def build_vocab_capped(spark, sf):
    return vo.build_vocab(sequences_of(spark, sf)[1], "cls_first", min_freq=5, max_size=40)


@query("vocabulary_words", f"""{SEQ} SELECT DISTINCT token FROM seq""")
def vocabulary_words(spark, sf):
    """The vocabulary without its special tokens."""
    return vocab_of(spark, sf)[2].where(~F.col("token").isin(vo.LAYOUTS["default"])).select("token")


_IDS = f"{SEQ}, {vocab_sql()}, ids AS (SELECT s.*, coalesce(t.id, 1) AS id FROM seq s LEFT JOIN voc t USING (token))"


@query("encode_tokens", f"{_IDS} SELECT session_id, pos, id AS token_id FROM ids")
def encode_tokens(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    return vo.encode_tokens(long, vocabulary).select("session_id", "pos", "token_id")


def _encoded_sql(where: str, tail: str = "") -> str:
    return f"""{_IDS}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ids),
    a AS (SELECT session_id, max(n) AS original_length, list_prepend(2, array_agg(id ORDER BY pos) FILTER ({where})) AS ids FROM n GROUP BY 1)
    SELECT session_id, original_length, len(ids) AS used_length,
      array_to_string(list_concat(ids, list_transform(range(64 - len(ids)), lambda x: 0)), ' ') AS input_ids,
      array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(64 - len(ids)), lambda x: 0)), ' ') AS attention_mask FROM a"""


def _joined(df):
    return df.select(
        "session_id", "original_length", "used_length", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


@query("encode_sequences", _encoded_sql("pos <= 63"))
def encode_sequences(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    return _joined(vo.encode_sequences(long, vocabulary, 64, KEYS))


@query("encode_sequences_left", _encoded_sql("pos > n - 63"))
def encode_sequences_left(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    return _joined(vo.encode_sequences(long, vocabulary, 64, KEYS, truncate="left"))


@query("left_padded", f"""{_IDS}, n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM ids),
    a AS (SELECT session_id, max(n) AS raw_len, array_agg(id ORDER BY pos) FILTER (pos > n - 8) AS ids FROM n GROUP BY 1)
    SELECT session_id, raw_len, array_to_string(list_concat(list_transform(range(8 - len(ids)), lambda x: 0), ids), ' ') AS ids FROM a""")
def left_padded(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    out = vo.left_padded(vo.encode_tokens(long, vocabulary), "token_id", 8, KEYS)
    return out.select("session_id", "raw_len", F.array_join(F.col("values").cast("array<string>"), " ").alias("ids"))


@query("mask_tokens", f"""{_IDS}, h AS (SELECT *, CAST(concat('0x', substr(md5(concat(session_id, ':', CAST(pos AS VARCHAR), ':42')), 1, 8)) AS BIGINT) % 100 < 15 AS m FROM ids)
    SELECT session_id, pos, CASE WHEN m THEN 3 ELSE id END AS masked_id, CASE WHEN m THEN id ELSE -100 END AS label FROM h""")
def mask_tokens(spark, sf):
    _, long, vocabulary = vocab_of(spark, sf)
    ids = vo.encode_tokens(long, vocabulary).select("session_id", "pos", "token_id")
    return vo.mask_tokens(ids)


# an external clickstream made of the same events
_TYPE = "CASE WHEN k % 3 = 0 THEN 'pageview' WHEN k % 17 = 1 THEN 'other' ELSE 'event_product' END"
_ACTION = "CASE WHEN k % 3 = 0 THEN NULL ELSE CASE k % 10 WHEN 0 THEN 'purchase' WHEN 1 THEN 'add' WHEN 2 THEN 'remove' WHEN 3 THEN 'click' WHEN 4 THEN '' ELSE 'detail' END END"
EXT = f"""{clicks_sql()}, ext AS (SELECT session_id AS session_id_hash, {_TYPE} AS event_type, {_ACTION} AS product_action,
    "timestamp" AS t, event_id, page_url, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", event_id) AS rn FROM clicks)"""
_TIME = "server_timestamp_epoch_ms"


def external_of(spark, sf):
    c = Clicks(spark, sf)
    return c, c.df.select(
        F.col("session_id").alias("session_id_hash"), F.expr(_TYPE).alias("event_type"), F.expr(_ACTION).alias("product_action"),
        F.col("timestamp").alias(_TIME), "event_id", "page_url",
    )


_EXT_TOKEN = """CASE concat(event_type, '/', coalesce(product_action, '')) WHEN 'event_product/detail' THEN 'PRODUCT|VIEW_PRODUCT|NONE'
    WHEN 'event_product/add' THEN 'PRODUCT|ADD_CART|NONE' WHEN 'event_product/remove' THEN 'CART|REMOVE_CART|NONE'
    WHEN 'event_product/purchase' THEN 'CHECKOUT|PURCHASE|NONE' ELSE CASE WHEN event_type = 'pageview' THEN
    CASE WHEN rn = 1 THEN 'HOME|ENTER_HOME|NONE' ELSE 'HOME|SCROLL_HOME|NONE' END END END"""


@query("external_sequences", f"""WITH {EXT}, t AS (SELECT *, {_EXT_TOKEN} AS token FROM ext),
    p AS (SELECT *, count(token) OVER (PARTITION BY session_id_hash ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pos FROM t)
    SELECT concat('ext_', session_id_hash) AS session_id, min(t) AS start_timestamp, max(t) AS end_timestamp,
      1 + count(token) AS length,
      concat('HOME|START_SESSION|NONE ', string_agg(token, ' ' ORDER BY rn) FILTER (token IS NOT NULL)) AS "sequence"
    FROM p GROUP BY session_id_hash HAVING count(token) >= 3""")
def external_sequences(spark, sf):
    c, e = external_of(spark, sf)
    out = build_external(e, [_TIME, "event_id"], 3, bounded=c.bounded)
    return out.withColumn("sequence", F.array_join("sequence", " "))


@query("external_sequences_by_url", f"""WITH {EXT}, u AS (SELECT *, CASE
      WHEN regexp_matches(lower(page_url), '/product|/item|/detail|/dp/') THEN 'PRODUCT' WHEN regexp_matches(lower(page_url), '/cart|/basket') THEN 'CART'
      WHEN regexp_matches(lower(page_url), '/checkout|/order|/payment') THEN 'CHECKOUT'
      WHEN regexp_matches(lower(page_url), '/search|/category|/collection|/browse') THEN 'CATEGORY' ELSE 'HOME' END AS pg FROM ext),
    t AS (SELECT *, CASE concat(event_type, '/', coalesce(product_action, '')) WHEN 'event_product/detail' THEN 'PRODUCT|VIEW_PRODUCT|NONE'
      WHEN 'event_product/add' THEN 'PRODUCT|ADD_CART|NONE' WHEN 'event_product/remove' THEN 'CART|REMOVE_CART|NONE'
      WHEN 'event_product/purchase' THEN 'CHECKOUT|CLICK_BUY|NONE' WHEN 'event_product/click' THEN 'CATEGORY|VIEW_PRODUCT|NONE'
      ELSE CASE WHEN event_type = 'pageview' THEN CASE pg WHEN 'PRODUCT' THEN 'PRODUCT|VIEW_PRODUCT|NONE'
        WHEN 'CATEGORY' THEN CASE WHEN rn = 1 THEN 'CATEGORY|ENTER_CATEGORY|NONE' ELSE 'CATEGORY|SCROLL_CATEGORY|NONE' END
        WHEN 'CART' THEN 'CART|ENTER_CART|NONE' WHEN 'CHECKOUT' THEN 'CHECKOUT|ENTER_CHECKOUT|NONE'
        ELSE CASE WHEN rn = 1 THEN 'HOME|ENTER_HOME|NONE' ELSE 'HOME|SCROLL_HOME|NONE' END END END END AS token FROM u),
    m AS (SELECT *, lag(token) OVER (PARTITION BY session_id_hash ORDER BY rn) AS b FROM t WHERE token IS NOT NULL),
    q AS (SELECT session_id_hash, token, row_number() OVER (PARTITION BY session_id_hash ORDER BY rn) AS pos FROM m WHERE b IS NULL OR b <> token),
    z AS (SELECT session_id_hash, min(t) AS s, max(t) AS e FROM ext GROUP BY 1)
    SELECT concat('ext_', session_id_hash) AS session_id, any_value(s) AS start_timestamp, any_value(e) AS end_timestamp,
      1 + count(*) AS length, concat('HOME|START_SESSION|NONE ', string_agg(token, ' ' ORDER BY pos)) AS "sequence"
    FROM q JOIN z USING (session_id_hash) GROUP BY session_id_hash HAVING count(*) >= 3""")
def external_sequences_by_url(spark, sf):
    c, e = external_of(spark, sf)
    out = build_external(e, [_TIME, "event_id"], 3, by_url=True, bounded=c.bounded)
    return out.withColumn("sequence", F.array_join("sequence", " "))


LABELLED = f"""{EXT}, g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY session_id_hash ORDER BY rn), 0) AS ms,
      count(*) OVER (PARTITION BY session_id_hash) AS raw_len,
      CASE nullif(product_action, '') WHEN 'detail' THEN 4 WHEN 'add' THEN 6 WHEN 'remove' THEN 7 WHEN 'purchase' THEN 8 ELSE 5 END AS id FROM ext),
    lab AS (SELECT session_id_hash AS session_id, any_value(raw_len) AS raw_len,
      array_agg(id ORDER BY rn) FILTER (rn > raw_len - 8) AS ids,
      array_agg(CASE WHEN (ms % 1000) > 950 OR (ms % 1000 = 950) THEN ms // 1000 + 1 ELSE ms // 1000 END ORDER BY rn) FILTER (rn > raw_len - 8) AS gaps,
      CASE WHEN bool_or(coalesce(product_action = 'purchase', false)) THEN 'conversion'
           WHEN bool_or(coalesce(product_action = 'add', false)) THEN 'cart_abandon' ELSE 'browse_only' END AS label_str
      FROM g GROUP BY 1 HAVING any_value(raw_len) >= 3)"""


@query("labelled_sessions", f"""WITH {LABELLED} SELECT session_id, raw_len, label_str,
    CASE label_str WHEN 'conversion' THEN 0 WHEN 'cart_abandon' THEN 1 ELSE 2 END AS label_id,
    array_to_string(list_concat(list_transform(range(8 - len(ids)), lambda x: 0), ids), ' ') AS token_ids,
    array_to_string(list_concat(list_transform(range(8 - len(ids)), lambda x: 0), gaps), ' ') AS time_gaps,
    array_to_string(list_concat(list_transform(range(8 - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)), ' ') AS attn_mask FROM lab""")
def labelled_sessions(spark, sf):
    c, e = external_of(spark, sf)
    out = ext.labelled_sessions(e, [_TIME, "event_id"], bounded=c.bounded)
    return out.select(
        "session_id", "raw_len", "label_str", "label_id",
        *(F.array_join(F.col(n).cast("array<string>"), " ").alias(n) for n in ("token_ids", "time_gaps", "attn_mask")),
    )


@query("class_weights", f"""WITH {LABELLED}, n AS (SELECT label_str, count(*) AS n FROM lab GROUP BY 1),
    w AS (SELECT *, sum(n) OVER () / (count(*) OVER () * n) AS w FROM n) SELECT label_str, n, round(w / min(w) OVER (), 6) AS weight FROM w""")
def class_weights(spark, sf):
    c, e = external_of(spark, sf)
    weights = ext.class_weights(ext.labelled_sessions(e, [_TIME, "event_id"], bounded=c.bounded), "label_str")
    return weights.withColumn("weight", F.round("weight", 6))


@query("undersample", f"""WITH {LABELLED}, h AS (SELECT session_id, label_str, row_number() OVER (PARTITION BY label_str = 'conversion' ORDER BY
      CAST(concat('0x', substr(md5(concat(session_id, ':7')), 1, 8)) AS BIGINT), session_id) AS r, count(*) FILTER (label_str <> 'conversion') OVER () AS m FROM lab)
    SELECT session_id, label_str FROM h WHERE label_str <> 'conversion' OR r <= 2 * m""")
def undersample(spark, sf):
    c, e = external_of(spark, sf)
    rows = cut(ext.labelled_sessions(e, [_TIME, "event_id"], bounded=c.bounded).select("session_id", "label_str"))
    return ext.undersample(rows, "label_str", "conversion", "session_id", 2, 7)


@query("merge_sequences", f"""WITH {EXT}, t AS (SELECT *, {_EXT_TOKEN} AS token FROM ext),
    n AS (SELECT session_id_hash, count(token) AS n, min(t) AS s, max(t) AS e,
      concat('HOME|START_SESSION|NONE ', string_agg(token, ' ' ORDER BY rn) FILTER (token IS NOT NULL)) AS "sequence" FROM t GROUP BY 1 HAVING count(token) >= 3)
    SELECT concat(p, session_id_hash) AS session_id, s AS start_timestamp, e AS end_timestamp, 1 + n AS length, "sequence"
    FROM n, (SELECT unnest(['ext_', 'aug_']) AS p)""")
def merge_sequences(spark, sf):
    c, e = external_of(spark, sf)
    real, more = (build_external(e, [_TIME, "event_id"], 3, prefix=p, bounded=c.bounded) for p in ("ext_", "aug_"))
    return ext.merge_sequences(real, more).withColumn("sequence", F.array_join("sequence", " "))
