"""Queries whose main path is DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.llm import sharding, urlrules, warc
from pathloom.llm.common import table
from pathloom.llm.registry import query

# --- URL rules ------------------------------------------------------------------------------------

_RULES_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM p),
r AS (
  SELECT *,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    CASE WHEN low LIKE '%blog.%.example.net/en/%' THEN 'blog.*.example.net/en/'
         WHEN contains(low, '/about/') THEN '/about/'
         WHEN low LIKE '%?%utm\\_source=feed%' ESCAPE '\\' THEN '?*utm_source=feed'
         WHEN low LIKE '%/login.%?%' THEN '/login.*?'
         WHEN contains(low, 'adult-x.') THEN 'adult-x.'
         WHEN contains(low, '-bets.') THEN '-bets.'
         WHEN contains(low, '/ads/') THEN '/ads/' END AS fits
  FROM s)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN fits IS NULL OR fits IN ('/about/', 'blog.*.example.net/en/') THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN fits END AS pattern
FROM r
"""


@query("op3_url_rules", _RULES_SQL)
def url_rules(spark, sf_dir):
    return urlrules.judge(table(spark, sf_dir, "pages"))


# --- shards ---------------------------------------------------------------------------------------

SHARDS, SEED = 40, 20_240_601


def _rounds_sql() -> str:
    """The rounds as one subquery each; ``v`` goes in and out."""
    inner = "SELECT n, v, total, a, b, v // b AS l, v % b AS r FROM {rows}"
    for i, key in enumerate(sharding.round_keys(SEED)):
        side, other, size = ("r", "l", "b") if i % 2 else ("l", "r", "a")
        mixed = f"(((({other} + {key}) % 2147483647) * (({other} + {key}) % 2147483647) % 2147483647) * 1103515245 + {key}) % 2147483647"
        kept = "l" if side == "r" else "r"
        inner = f"SELECT n, total, a, b, {kept}, ({side} + {mixed}) % {size} AS {side} FROM ({inner})"
    return f"SELECT n, l * b + r AS v, total, a, b FROM ({inner})"


_SHARDS_SQL = f"""
WITH RECURSIVE c AS (SELECT count(*) AS total, CAST(floor(sqrt(greatest(count(*), 1))) AS BIGINT) AS root FROM documents),
sides AS (
  SELECT total, a, (greatest(total, 1) + a - 1) // a AS b FROM (SELECT total, root + unnest(range(64)) AS a FROM c)
  ORDER BY a * ((greatest(total, 1) + a - 1) // a), a LIMIT 1),
bits AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda h: CAST(strpos('0123456789ABCDEF', h[1]) * 16 + strpos('0123456789ABCDEF', h[2]) - 17 AS BIGINT))),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS text_crc32
  FROM documents, bits),
m AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS n FROM d),
walk AS (
  SELECT n, v, total, a, b FROM ({_rounds_sql().format(rows="(SELECT m.n AS n, m.n AS v, total, a, b FROM m, sides)")})
  UNION ALL
  SELECT n, v, total, a, b FROM ({_rounds_sql().format(rows="(SELECT * FROM walk WHERE v >= total)")}))
SELECT m.doc_id, CAST(m.size AS BIGINT) AS size, CAST(m.text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(v % {SHARDS} AS INTEGER) AS shard, CAST(v // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM m JOIN walk USING (n) WHERE v < total
"""


@query("op5_feistel_shards", _SHARDS_SQL)
def feistel_shards(spark, sf_dir):
    at = sharding.assign(table(spark, sf_dir, "documents"), SHARDS, SEED)
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# --- revisits -------------------------------------------------------------------------------------

#: Captures of each page: one full response and two revisits. Minutes, so that captures of a URL interleave.
_TAG = "concat('\"', substr(digest, 1, 16), '\"')"
_CAPTURES = {
    "record_id": "page_id * 3 + k",
    "ts": "page_id * 37 % 1000 * 10 + k * (5 + page_id % 4) + CASE WHEN page_id % 9 = 4 THEN -20 * k ELSE 0 END",
    "type": "CASE WHEN k = 0 THEN 'response' ELSE 'revisit' END",
    "payload_digest": "CASE WHEN k = 0 THEN digest WHEN page_id % 6 = 0 THEN digest END",
    "etag": f"CASE WHEN page_id % 7 = 3 THEN NULL WHEN k = 2 AND page_id % 5 = 1 THEN '\"stale\"' WHEN k = 1 AND page_id % 2 = 0 THEN concat('W/', {_TAG}) ELSE {_TAG} END",
    "modified": "CASE WHEN page_id % 11 = 5 THEN NULL ELSE concat('day ', CAST(page_id % 28 AS VARCHAR(9))) END",
    "length": "CASE WHEN k = 0 THEN n_bytes ELSE 0 END",
    "cache": "concat('max-age=', CAST(k * 60 AS VARCHAR(9)))",
}


def captures(pages):
    """Three records per page, of which two are revisits. Bodies are hashed once and left behind."""
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    seen = pages.select("page_id", "url", F.md5(raw).alias("digest"), F.length(raw).alias("n_bytes"))
    rows = seen.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "url", *(F.expr(sql).alias(name) for name, sql in _CAPTURES.items())
    )
    pairs = [("ETag", "etag"), ("Last-Modified", "modified"), ("Content-Length", "length"), ("Cache-Control", "cache")]
    headers = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in pairs))
    return rows.select("record_id", "url", "ts", "type", "payload_digest", F.filter(headers, lambda h: h["value"].isNotNull()).alias("headers"))


_REVISITS_SQL = f"""
WITH c AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n_bytes, unnest([0, 1, 2]) AS k FROM pages),
u AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in _CAPTURES.items())},
  regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '#.*$', '') AS rest FROM c),
q AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS host, rtrim(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/') AS path,
  list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN split_part(rest, '?', 2) ELSE '' END, '&'),
    lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref='))) AS params FROM u),
v AS (SELECT *, concat(lower(host), path, CASE WHEN len(params) > 0 THEN concat('?', array_to_string(params, '&')) ELSE '' END) AS key FROM q),
best AS (
  SELECT r.record_id, max(struct_pack(ts := f.ts, record_id := f.record_id)) AS f
  FROM v r JOIN v f ON f.key = r.key AND f.k = 0 AND r.k > 0 AND f.ts < r.ts GROUP BY r.record_id),
j AS (
  SELECT r.*, f.record_id AS f_id, f.payload_digest AS f_digest, f.etag AS f_etag, f.modified AS f_modified, f.length AS f_length, f.cache AS f_cache,
    CASE WHEN f.record_id IS NULL THEN NULL WHEN r.etag IS NOT NULL AND f.etag IS NOT NULL THEN 'etag'
         WHEN r.modified IS NOT NULL AND f.modified IS NOT NULL THEN 'last-modified'
         WHEN r.payload_digest IS NOT NULL THEN 'digest' END AS validator
  FROM v r LEFT JOIN best b ON b.record_id = r.record_id LEFT JOIN v f ON f.record_id = b.f.record_id WHERE r.k > 0),
s AS (
  SELECT *, CASE WHEN f_id IS NULL THEN 'no response' WHEN validator IS NULL THEN 'no validator'
    WHEN payload_digest IS NOT NULL AND payload_digest <> f_digest THEN 'differs'
    WHEN validator = 'etag' AND replace(etag, 'W/', '') <> replace(f_etag, 'W/', '') THEN 'differs'
    WHEN validator = 'last-modified' AND modified <> f_modified THEN 'differs' ELSE 'resolved' END AS state FROM j)
SELECT record_id, key, CAST(ts AS BIGINT) AS ts, state, f_id AS refers_to, validator,
  CASE WHEN state = 'resolved' THEN f_digest ELSE payload_digest END AS payload_digest,
  CASE WHEN state = 'resolved' THEN concat_ws(chr(10),
      CASE WHEN etag IS NULL THEN 'ETag: ' || f_etag END, CASE WHEN modified IS NULL THEN 'Last-Modified: ' || f_modified END,
      'Content-Length: ' || f_length, 'ETag: ' || etag, 'Last-Modified: ' || modified, 'Cache-Control: ' || cache)
    ELSE concat_ws(chr(10), 'ETag: ' || etag, 'Last-Modified: ' || modified, 'Content-Length: ' || length, 'Cache-Control: ' || cache) END AS headers
FROM s
"""


@query("op1_revisits", _REVISITS_SQL)
def revisits(spark, sf_dir):
    resolved = warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return resolved.select(
        "record_id", "key", F.col("ts").cast("long").alias("ts"), "state", "refers_to", "validator", "payload_digest",
        F.array_join(lines, "\n").alias("headers"),
    )
