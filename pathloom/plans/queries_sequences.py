"""Registered queries: tokens and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import pages, tokens as tk
from pathloom.functions.rules import pattern_of
from pathloom.operators import sequences as sq
from pathloom.plans.fixtures import Clicks, clicks_sql, table
from pathloom.plans.registry import query

W = 'PARTITION BY session_id ORDER BY "timestamp", event_id'
UPTO = f"({W} ROWS UNBOUNDED PRECEDING)"
KEYS = Clicks.KEYS


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _case(subject: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({subject}, '{pattern_of(pat)}') THEN '{value}'" for value, pat in rules)
    return f"CASE {whens} ELSE {default} END"


def _map(subject: str, table_: dict) -> str:
    return "CASE " + subject + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def page_sql(preset: str) -> str:
    path = "regexp_replace(lower(pathname), '/+$', '')"
    late = _case(path, pages.PAGE_RULES_AFTER_QUERY, "'UNKNOWN'")
    return f"CASE WHEN {path} IN ('', '/home', '/main') THEN 'HOME' ELSE {_case(path, pages.PAGE_RULES[preset], late)} END"


AREA = _case("coalesce(nullif(lower(subsection), ''), lower(coalesce(section, '')))", pages.AREAS, "'UNKNOWN_AREA'")
DWELL_AREA = _case("coalesce(lower(p_subsection_id), lower(subsection), lower(coalesce(section, '')))", pages.AREAS, "'UNKNOWN_AREA'")
OWN_AREA = _case("lower(coalesce(p_section, ''))", [r for n in ("PRICE", "REVIEW", "SHIPPING", "SIZE") for r in pages.AREAS if r[0] == n], "NULL")
POINTED = f"coalesce({_map('own_area', tk.POINTED)}, {_map('area', tk.POINTED)})"


def _bucket(col: str, low: float, high: float, names) -> str:
    return f"CASE WHEN {col} <= {low} THEN '{names[0]}' WHEN {col} <= {high} OR {col} IS NULL THEN '{names[1]}' ELSE '{names[2]}' END"


_DWELL = ("DWELL_SHORT", "DWELL_MEDIUM", "DWELL_LONG")
_SCROLL = ("SCROLL_LOW", "SCROLL_MID", "SCROLL_HIGH")

TOKENS_SQL = f"""
t0 AS (SELECT *, {page_sql('compat')} AS own_page FROM clicks WHERE event_type NOT IN {_in(tk.IGNORED_EVENTS)}),
t1 AS (SELECT *, last_value(CASE WHEN own_page <> 'UNKNOWN' THEN own_page END IGNORE NULLS) OVER {UPTO} AS page,
    last_value(CASE WHEN event_type = 'section_enter' THEN p_section END IGNORE NULLS) OVER {UPTO} AS in_sec,
    last_value(CASE WHEN event_type = 'subsection_enter' THEN p_subsection_id END IGNORE NULLS) OVER {UPTO} AS in_sub,
    sum(CASE WHEN event_type = 'section_enter' THEN 1 ELSE 0 END) OVER {UPTO} AS sec_epoch,
    sum(CASE WHEN event_type = 'subsection_enter' THEN 1 ELSE 0 END) OVER {UPTO} AS sub_epoch FROM t0),
t2 AS (SELECT *,
    CASE WHEN NOT bool_or(coalesce(event_type = 'section_exit' AND p_section = in_sec, false)) OVER (PARTITION BY session_id, sec_epoch
         ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) THEN in_sec END AS section,
    CASE WHEN NOT bool_or(coalesce(event_type = 'subsection_exit' AND p_subsection_id = in_sub, false)) OVER (PARTITION BY session_id,
         sub_epoch ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING) THEN in_sub END AS subsection FROM t1),
t3 AS (SELECT *, {AREA} AS area, {DWELL_AREA} AS dwell_area, {OWN_AREA} AS own_area,
    {_case("lower(coalesce(nullif(p_hover_text, ''), ''))", tk.TEXT_SEMANTICS, 'NULL')} AS hover_sem,
    {_case("lower(coalesce(nullif(p_click_text, ''), p_click_target, ''))", tk.TEXT_SEMANTICS, 'NULL')} AS click_sem FROM t2),
t4 AS (SELECT *, CASE WHEN coalesce(page, own_page) = 'HOME' AND (event_type IN {_in(tk.PRODUCT_EVENTS)} OR area <> 'UNKNOWN_AREA')
    THEN 'PRODUCT' ELSE coalesce(page, own_page) END AS at_page FROM t3),
t5 AS (SELECT *, CASE
    WHEN event_type = 'navigation' THEN concat('ENTER_', own_page)
    WHEN event_type = 'session_end' THEN CASE WHEN p_bounce_flag THEN 'EXIT_BOUNCE' ELSE 'EXIT_SESSION' END
    WHEN event_type IN ('scroll_depth', 'scroll_milestone') THEN coalesce({_map('area', tk.SCROLLED)},
        CASE WHEN at_page = 'PRODUCT' OR area IN ('PRODUCT_DETAIL', 'IMAGE') THEN 'SCROLL_PRODUCT' WHEN at_page = 'HOME' THEN 'SCROLL_HOME'
        WHEN at_page = 'CATEGORY' THEN 'SCROLL_CATEGORY' ELSE 'SCROLL_PAGE' END)
    WHEN event_type = 'subsection_dwell' THEN coalesce({_map('dwell_area', tk.DWELT)}, 'VIEW_SECTION')
    WHEN event_type IN ('section_enter', 'subsection_enter') THEN {_map('area', tk.ENTERED)}
    WHEN event_type IN ('section_revisit', 'subsection_revisit') THEN {_map('area', tk.REVISITED)}
    WHEN event_type = 'hover_dwell' THEN CASE WHEN hover_sem = 'CHECK_SIZE' OR area = 'SIZE' THEN 'CHECK_SIZE'
        ELSE coalesce(hover_sem, {_map('area', tk.POINTED)}, 'HOVER_ELEMENT') END
    WHEN event_type = 'hover' THEN coalesce(hover_sem, {POINTED}, 'HOVER_ELEMENT')
    WHEN event_type = 'click' THEN coalesce(click_sem, {POINTED}, 'CLICK_ELEMENT')
    ELSE {_map('event_type', tk.EVENT_SEMANTICS)} END AS sem FROM t4),
t6 AS (SELECT *, CASE WHEN sem NOT IN {_in(tk.CONTEXT_SEMANTICS)} THEN 'NONE'
    WHEN event_type IN ('review_scroll', 'review_area_scroll') THEN {_bucket('p_depth_pct', 30, 70, _SCROLL)}
    WHEN event_type IN ('scroll_depth', 'scroll_milestone') AND sem <> 'CHECK_SHIPPING' THEN {_bucket('p_depth_pct', 30, 70, _SCROLL)}
    WHEN event_type = 'subsection_dwell' THEN {_bucket('p_dwell_ms', 5000, 20000, _DWELL)}
    WHEN event_type = 'section_revisit' THEN CASE WHEN p_count <= 1 OR p_count IS NULL THEN 'REVISIT_ONCE' ELSE 'REVISIT_MULTI' END
    WHEN event_type = 'hover_dwell' AND sem = 'CHECK_SIZE' THEN CASE WHEN p_hover_dwell_time_ms <= 5000 OR p_hover_dwell_time_ms IS NULL
        THEN 'HOVER_SHORT' ELSE 'HOVER_LONG' END
    WHEN event_type = 'hover_dwell' THEN {_bucket('p_hover_dwell_time_ms', 5000, 20000, _DWELL)}
    ELSE 'NONE' END AS ctx FROM t5),
tok AS (SELECT *, concat(CASE WHEN event_type = 'navigation' THEN own_page ELSE at_page END, '|', sem, '|', ctx) AS token
    FROM t6 WHERE sem IS NOT NULL)
"""


def compress_sql(src: str, order: str, key: str = "session_id") -> str:
    """Repeats dropped, runs shrunk by gaps and islands, episodes by an explicit list of recent intents (recursive)."""
    return f"""
d0 AS (SELECT {key} AS sid, {order}, token, lag(token) OVER (PARTITION BY {key} ORDER BY {order}) AS before FROM {src}),
d1 AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY {order}) AS rn, token, split_part(token, '|', 1) AS pg,
    split_part(token, '|', 2) AS sem FROM d0 WHERE before IS NULL OR before <> token),
d2 AS (SELECT *, CASE WHEN sem IN {_in(sq.FOCUS_AWAY)} THEN 'away' WHEN sem IN {_in(sq.SCROLL_NOISE)} THEN sem
    WHEN sem IN {_in(sq.GENERIC_NOISE)} THEN 'generic' END AS cls FROM d1),
d3 AS (SELECT *, CASE WHEN cls IS NOT NULL AND cls = lag(cls) OVER (PARTITION BY sid ORDER BY rn) THEN 0 ELSE 1 END AS o FROM d2),
d4 AS (SELECT *, sum(o) OVER (PARTITION BY sid ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM d3),
d5 AS (SELECT *, count(*) OVER (PARTITION BY sid, run) AS len, row_number() OVER (PARTITION BY sid, run ORDER BY rn) AS i FROM d4),
shrunk AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY rn) AS rn, CASE WHEN cls IS NULL OR len < 3 OR cls = 'generic' THEN token
    WHEN cls = 'away' THEN concat(pg, '|DISTRACTED_EPISODE|REPEAT') ELSE concat(pg, '|', sem, '|SCROLLED') END AS token
    FROM d5 WHERE cls IS NULL OR len < 3 OR i = 1),
g0 AS (SELECT *, split_part(token, '|', 1) AS pg, split_part(token, '|', 2) AS sem FROM shrunk),
g1 AS (SELECT *, CASE WHEN regexp_matches(sem, '{sq.EPISODE_RESETS}') THEN 'reset' WHEN sem IN {_in(sq.EPISODES)} THEN 'intent'
    ELSE 'pass' END AS what FROM g0),
walk(sid, rn, recent, done, mark) AS (
    SELECT sid, rn, CASE WHEN what = 'intent' THEN [sem] ELSE CAST([] AS VARCHAR[]) END, CAST([] AS VARCHAR[]), false FROM g1 WHERE rn = 1
    UNION ALL
    SELECT sid, rn, recent, CASE WHEN mark THEN list_append(done, sem) ELSE done END, mark FROM (
      SELECT sid, rn, sem, recent, done, what = 'intent' AND len(list_filter(recent, lambda x: x = sem)) >= 2
             AND NOT list_contains(done, sem) AS mark FROM (
        SELECT n.sid, n.rn, n.sem, n.what,
          CASE n.what WHEN 'reset' THEN CAST([] AS VARCHAR[]) WHEN 'pass' THEN w.recent ELSE list_append(w.recent, n.sem)[-8:] END AS recent,
          CASE n.what WHEN 'reset' THEN CAST([] AS VARCHAR[]) WHEN 'pass' THEN w.done
               ELSE CASE WHEN len(w.recent) >= 8 THEN list_intersect(w.done, list_append(w.recent, n.sem)[-8:]) ELSE w.done END END AS done
        FROM walk w JOIN g1 n ON n.sid = w.sid AND n.rn = w.rn + 1))),
h0 AS (SELECT g1.sid, g1.rn, 0 AS sub, g1.token FROM g1
    UNION ALL SELECT g1.sid, g1.rn, 1, concat(g1.pg, '|', {_map('g1.sem', sq.EPISODES)}, '|STRONG') FROM g1 JOIN walk w
      ON w.sid = g1.sid AND w.rn = g1.rn WHERE w.mark),
seq AS (SELECT sid AS {key}, row_number() OVER (PARTITION BY sid ORDER BY rn, sub) AS pos, token FROM h0)
"""


CLICKS = "WITH " + clicks_sql()
TOK = f"{CLICKS}, {TOKENS_SQL}"
RSEQ_CTES = f"{clicks_sql()}, {TOKENS_SQL}, {compress_sql('tok', chr(34) + 'timestamp' + chr(34) + ', event_id')}"
SEQ = f"WITH RECURSIVE {RSEQ_CTES}"


def tokens_of(spark, sf):
    c = Clicks(spark, sf)
    return c, sq.semantic_tokens(c.df, KEYS, bounded=c.bounded)


def sequences_of(spark, sf):
    """Long sequences of all sessions, keyed by session alone."""
    c = Clicks(spark, sf)
    return c, sq.semantic_sequences(c.df, KEYS, bounded=c.bounded)


@query("track_section", f"{TOK} SELECT event_id, page, section, subsection FROM t2")
def track_section(spark, sf):
    from pathloom.operators.ordered import ordered
    from pathloom.operators.sessions import ORDER

    c = Clicks(spark, sf)
    rows = c.df.where(~F.col("event_type").isin(tk.IGNORED_EVENTS))
    out = ordered(rows, KEYS, ORDER, lambda k: sq.track_place(k).df, c.bounded)
    return out.select("event_id", "page", "section", "subsection")


@query("ffill_context", f"""{CLICKS} SELECT event_id, last_value(p_product_id IGNORE NULLS) OVER {UPTO} AS product_id,
    last_value(p_section IGNORE NULLS) OVER {UPTO} AS section, last_value(p_position IGNORE NULLS) OVER {UPTO} AS scroll FROM clicks""")
def ffill_context(spark, sf):
    from pathloom.operators.sessions import carry_context

    c = Clicks(spark, sf)
    columns = {"product_id": F.col("p.product_id"), "section": F.col("p.section"), "scroll": F.col("p.position")}
    return carry_context(c.df.select(*KEYS, "timestamp", "event_id", "p"), columns, KEYS, bounded=c.bounded).select("event_id", *columns)


@query("semantic_tokens", f"{TOK} SELECT event_id, page, section, subsection, token FROM tok")
def semantic_tokens(spark, sf):
    return tokens_of(spark, sf)[1].select("event_id", "page", "section", "subsection", "token")


@query("dedupe_consecutive", f"""{TOK}, d AS (SELECT event_id, token, lag(token) OVER ({W}) AS b FROM tok)
    SELECT event_id, token FROM d WHERE b IS NULL OR b <> token""")
def dedupe_consecutive(spark, sf):
    from pathloom.operators.ordered import ordered
    from pathloom.operators.sessions import ORDER

    c, tokens = tokens_of(spark, sf)
    return ordered(tokens, KEYS, ORDER, lambda k: sq.drop_repeats(k).df, c.bounded).select("event_id", "token")


@query("collapse_runs", f"{SEQ} SELECT sid AS session_id, rn AS pos, token FROM shrunk")
def collapse_runs(spark, sf):
    c = Clicks(spark, sf)
    return sq.semantic_sequences(c.df, KEYS, episodes=False, bounded=c.bounded).drop("user_id")


@query("semantic_sequences", f"{SEQ} SELECT session_id, pos, token FROM seq")
def semantic_sequences(spark, sf):
    return sequences_of(spark, sf)[1].drop("user_id")


@query("promote_episodes", f"""{SEQ} SELECT session_id, pos, token FROM seq WHERE token LIKE '%EPISODE|STRONG'""")
def promote_episodes(spark, sf):
    return sequences_of(spark, sf)[1].where(F.col("token").endswith("EPISODE|STRONG")).drop("user_id")


@query("sequence_parts", f"""{SEQ} SELECT session_id, (pos - 1) // 16 AS part, string_agg(token, ' ' ORDER BY pos) AS "sequence",
    count(*) AS n FROM seq GROUP BY 1, 2""")
def sequence_parts(spark, sf):
    parts = sq.in_parts(sequences_of(spark, sf)[1], KEYS, "token", rows=16)
    return parts.select("session_id", "part", F.array_join("values", " ").alias("sequence"), F.size("values").alias("n"))


@query("sequence_summary", f"""{SEQ}, e AS (SELECT session_id, min("timestamp") AS start_timestamp, max("timestamp") AS end_timestamp
      FROM clicks GROUP BY 1), n AS (SELECT session_id, count(*) AS n, count(*) FILTER (token LIKE 'UNKNOWN|%') AS u FROM seq GROUP BY 1)
    SELECT session_id, start_timestamp, end_timestamp, coalesce(n, 0) AS length FROM e LEFT JOIN n USING (session_id)
    WHERE coalesce(u / n, 0) <= 0.5""")
def sequence_summary(spark, sf):
    c, long = sequences_of(spark, sf)
    return sq.sequence_summary(c.df, long, KEYS).drop("user_id")


@query("unknown_ratio_filter", f"""{SEQ}, n AS (SELECT session_id, count(*) AS length,
      count(*) FILTER (token LIKE 'UNKNOWN|%') / count(*) AS r FROM seq GROUP BY 1)
    SELECT session_id, length, round(r, 6) AS unknown_ratio FROM n WHERE r <= 0.1""")
def unknown_ratio_filter(spark, sf):
    ratio = sq.unknown_ratio(sequences_of(spark, sf)[1], KEYS)
    return ratio.where("unknown_ratio <= 0.1").select("session_id", "length", F.round("unknown_ratio", 6).alias("unknown_ratio"))


@query("min_length_filter", f"""{SEQ}, n AS (SELECT session_id FROM seq GROUP BY 1 HAVING count(*) >= 5)
    SELECT session_id, pos, token FROM seq SEMI JOIN n USING (session_id)""")
def min_length_filter(spark, sf):
    return sq.at_least(sequences_of(spark, sf)[1], 5, KEYS).drop("user_id")


@query("event_sequences", f"""{CLICKS} SELECT session_id, event_seq AS pos, CASE WHEN event_type = 'scroll_depth'
    THEN concat('scroll_', CAST(CAST(coalesce(p_depth_pct, 0) AS INTEGER) AS VARCHAR)) ELSE event_type END AS token FROM clicks""")
def event_sequences(spark, sf):
    c = Clicks(spark, sf)
    return sq.event_sequences(c.df, KEYS, bounded=c.bounded).drop("user_id")


@query("token_parts", f"""{SEQ} SELECT split_part(token, '|', 1) AS page, split_part(token, '|', 2) AS semantic,
    split_part(token, '|', 3) AS contextual, count(*) AS n FROM seq GROUP BY 1, 2, 3""")
def token_parts(spark, sf):
    page, semantic, context = tk.token_parts(F.col("token"))
    long = sequences_of(spark, sf)[1]
    return long.groupBy(page.alias("page"), semantic.alias("semantic"), context.alias("contextual")).agg(F.count(F.lit(1)).alias("n"))


@query("sequence_audit", f"""{TOK} SELECT 'token' AS dimension, token AS value, count(*) AS n FROM tok GROUP BY 2
    UNION ALL SELECT 'event', event_type, count(*) FROM tok GROUP BY 2
    UNION ALL SELECT 'page', coalesce(page, 'UNKNOWN_PAGE'), count(*) FROM tok GROUP BY 2
    UNION ALL SELECT 'section', coalesce(section, 'NO_SECTION'), count(*) FROM tok GROUP BY 2
    UNION ALL SELECT 'semantic', sem, count(*) FROM tok GROUP BY 2
    UNION ALL SELECT 'contextual', ctx, count(*) FROM tok GROUP BY 2""")
def sequence_audit(spark, sf):
    return sq.sequence_audit(tokens_of(spark, sf)[1])


@query("top_tokens_by_section", f"""{TOK}, c AS (SELECT coalesce(section, 'NO_SECTION') AS "group", token, count(*) AS n FROM tok GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, token) AS "rank" FROM c QUALIFY "rank" <= 10""")
def top_tokens_by_section(spark, sf):
    return sq.top_tokens_by(tokens_of(spark, sf)[1], F.coalesce(F.col("section"), F.lit("NO_SECTION")))


@query("top_tokens_by_page", f"""{TOK}, c AS (SELECT split_part(token, '|', 1) AS "group", token, count(*) AS n FROM tok GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, token) AS "rank" FROM c QUALIFY "rank" <= 10""")
def top_tokens_by_page(spark, sf):
    return sq.top_tokens_by(tokens_of(spark, sf)[1], tk.token_parts(F.col("token"))[0])


@query("length_summary", f"""{TOK}, n AS (SELECT session_id, count(*) AS length FROM tok GROUP BY 1)
    SELECT count(*) AS sessions, count(*) AS non_empty, sum(length) AS tokens, min(length) AS min_length, max(length) AS max_length,
    round(avg(length), 2) AS avg_length, count(*) FILTER (length >= 100) AS long_sessions, count(*) FILTER (length <= 2) AS short_sessions FROM n""")
def length_summary(spark, sf):
    return sq.length_summary(sq.session_lengths(tokens_of(spark, sf)[1], KEYS))


@query("length_histogram", f"""{TOK}, n AS (SELECT session_id, count(*) AS length FROM tok GROUP BY 1),
    m AS (SELECT min(length) AS lo, max(length) AS hi FROM n)
    SELECT CAST(least(floor((length - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM n, m GROUP BY 1""")
def length_histogram(spark, sf):
    return sq.length_histogram(sq.session_lengths(tokens_of(spark, sf)[1], KEYS))


@query("session_length_list", f"""{TOK} SELECT session_id, count(*) AS length FROM tok GROUP BY 1""")
def session_length_list(spark, sf):
    return sq.session_lengths(tokens_of(spark, sf)[1], KEYS).drop("user_id")


@query("first_events", f"{CLICKS} SELECT event_id FROM clicks WHERE event_seq <= 3")
def first_events(spark, sf):
    # sessionizing already numbers the events
    return Clicks(spark, sf).df.where("event_seq <= 3").select("event_id")


@query("page_types", f"""{CLICKS} SELECT event_id, {page_sql('compat')} AS compat, {page_sql('fixed')} AS fixed,
    {_case("lower(concat(pathname, ' ', page_url))", pages.SIMPLE_PAGES, "'home'")} AS simple,
    {_case("lower(page_url)", pages.EXTERNAL_PAGES, "'HOME'")} AS external FROM clicks""")
def page_types(spark, sf):
    path, url = F.col("pathname"), F.col("page_url")
    df = pages.with_page(pages.with_page(Clicks(spark, sf).df, "compat"), "fixed", "fixed")
    return df.select(
        "event_id", "compat", "fixed",
        pages.simple_page(path, url).alias("simple"), pages.external_page(url).alias("external"),
    )


@query("normalize_event_type", f"""{CLICKS}, a AS (SELECT *, {_case("lower(concat(pathname, ' ', page_url))", pages.SIMPLE_PAGES, "'home'")} AS sp FROM clicks)
    SELECT event_id, sp AS page, CASE
      WHEN event_type = 'subsection_enter' THEN coalesce({_map('p_subsection_id', tk.LIVE_SUBSECTIONS)}, 'CLICK_ELEMENT')
      WHEN coalesce(contains(concat(coalesce(p_hover_text, ''), ' ', coalesce(p_click_text, '')), '주문이 완료'), false)
        OR coalesce(contains(lower(p_click_target), 'complete'), false) THEN 'CLICK_BUY'
      WHEN event_type = 'product_click' AND sp = 'product' THEN 'ENTER_PRODUCT'
      WHEN event_type = 'click' AND sp = 'checkout' THEN 'CLICK_BUY'
      WHEN event_type IN ('click', 'product_click') THEN 'CLICK_ELEMENT'
      WHEN event_type IN ('scroll_depth', 'scroll_stop', 'scroll_milestone') AND sp = 'product' THEN 'SCROLL_PRODUCT'
      WHEN event_type IN ('scroll_depth', 'scroll_stop', 'scroll_milestone') AND sp = 'home' THEN 'SCROLL_HOME'
      ELSE coalesce({_map('event_type', tk.LIVE_ACTIONS)}, event_type) END AS action FROM a""")
def normalize_event_type(spark, sf):
    page = pages.simple_page(F.col("pathname"), F.col("page_url"))
    return Clicks(spark, sf).df.select(
        "event_id", page.alias("page"), tk.normalize_event_type(F.col("event_type"), F.col("p"), page).alias("action")
    )


REMAP = {"HOME|SCROLL_HOME|NONE": "[UNK]", "PRODUCT|EXIT_SESSION|NONE": "PRODUCT|VIEW_PRODUCT|DWELL_SHORT",
         "HOME|EXIT_BOUNCE|NONE": "HOME|EXIT_SESSION|NONE"}


@query("remap_tokens", f"""{SEQ}, r AS (SELECT session_id, pos, CASE WHEN token LIKE 'CART|%' THEN token ELSE nullif({_map('token', REMAP)}, '[UNK]') END AS t FROM seq)
    SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS pos, t AS token FROM r WHERE t IS NOT NULL""")
def remap_tokens(spark, sf):
    from pathloom.session import cut

    c, long = sequences_of(spark, sf)
    long = cut(long)
    vocabulary = long.where(F.col("token").startswith("CART|")).select("token")
    return sq.remap_tokens(long, vocabulary, REMAP, KEYS, c.bounded)[0].drop("user_id")


@query("remap_dropped", f"""{SEQ} SELECT session_id, count(*) FILTER (token NOT LIKE 'CART|%' AND
    nullif({_map('token', REMAP)}, '[UNK]') IS NULL) AS unk_count FROM seq GROUP BY 1""")
def remap_dropped(spark, sf):
    from pathloom.session import cut

    c, long = sequences_of(spark, sf)
    long = cut(long)
    vocabulary = long.where(F.col("token").startswith("CART|")).select("token")
    return sq.remap_tokens(long, vocabulary, REMAP, KEYS, c.bounded)[1].drop("user_id")


CONV = """WITH RECURSIVE cv AS (SELECT conv_id, turn, concat('HOME|', CASE role WHEN 'user' THEN 'CHECK_PRICE' WHEN 'assistant' THEN
    CASE WHEN turn % 4 = 1 THEN 'TAB_OUT' ELSE 'INACTIVE' END ELSE 'START_SESSION' END, '|NONE') AS token FROM conversations)"""


@query("conversation_sequences", f"""{CONV}, {compress_sql('cv', 'turn', 'conv_id')} SELECT conv_id, pos, token FROM seq""")
def conversation_sequences(spark, sf):
    away = F.when(F.col("turn") % 4 == 1, "TAB_OUT").otherwise("INACTIVE")
    name = F.when(F.col("role") == "user", "CHECK_PRICE").when(F.col("role") == "assistant", away).otherwise("START_SESSION")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("HOME|"), name, F.lit("|NONE")).alias("token"))
    return sq.compress(rows, ["conv_id"], ["turn"])
