"""Registered queries: hotspots, funnel, cluster profiles, names and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import tokens as tk
from pathloom.operators import features, profiles as pf, reports as rp
from pathloom.plans.fixtures import Clicks, clicks_sql
from pathloom.plans.queries_sequences import KEYS, SEQ, _in, _map, sequences_of
from pathloom.plans.registry import query
from pathloom.session import cut

CLICKS = "WITH " + clicks_sql()

_W = "(PARTITION BY session_id ORDER BY event_seq ROWS UNBOUNDED PRECEDING)"
EXITS_SQL = f"""x0 AS (SELECT * FROM clicks WHERE event_type IN {_in([*rp.EXIT_EVENTS, *rp.PLACE_EVENTS])}),
x1 AS (SELECT *, regexp_replace(page_url, '#.*$', '') AS url, last_value(p_section IGNORE NULLS) OVER {_W} AS sec,
    last_value(p_subsection_id IGNORE NULLS) OVER {_W} AS sub, last_value(p_position IGNORE NULLS) OVER {_W} AS pos FROM x0),
exits AS (SELECT event_id, event_type, url, coalesce(sec, sub, 'unknown') AS section, CAST(coalesce(pos, 0) AS BIGINT) AS scroll_y FROM x1
    WHERE event_type IN {_in(rp.EXIT_EVENTS)})"""
_SPOTS = f"""{CLICKS}, {EXITS_SQL}, g AS (SELECT url, section, scroll_y // 500 * 500 AS scroll_bucket, event_type, count(*) AS n, sum(scroll_y) AS y FROM exits GROUP BY ALL),
    s AS (SELECT url, section, scroll_bucket, sum(n) AS "count", floor(sum(y) / sum(n)) AS scroll_y,
      string_agg(concat(event_type, ':', CAST(n AS VARCHAR)), ' ' ORDER BY event_type) AS event_types FROM g GROUP BY ALL),
    t AS (SELECT *, round_even("count" * 100 / sum("count") OVER (), 0) AS share_pct FROM s)"""


def exits_of(spark, sf):
    c = Clicks(spark, sf)
    return rp.exit_places(c.df, KEYS, order=["event_seq", "event_id"], bounded=c.bounded)


def _spots(df):
    pairs = F.transform(F.map_entries("event_types"), lambda e: F.format_string("%s:%d", e["key"], e["value"]))
    return df.withColumn("event_types", F.array_join(pairs, " "))


@query("exit_places", f"{CLICKS}, {EXITS_SQL} SELECT * FROM exits")
def exit_places(spark, sf):
    return exits_of(spark, sf).drop(*KEYS)


@query("exit_hotspots", f"""{_SPOTS} SELECT * FROM t ORDER BY "count" DESC, url, section, scroll_bucket LIMIT 3""")
def exit_hotspots(spark, sf):
    return _spots(rp.exit_hotspots(exits_of(spark, sf)))


@query("exit_hotspots_all", f"{_SPOTS} SELECT * FROM t")
def exit_hotspots_all(spark, sf):
    return _spots(rp.exit_hotspots(exits_of(spark, sf), limit=None))


# stand-in clusters: the user's number modulo 6, −1 is noise
ASG = "asg AS (SELECT DISTINCT session_id, user_id % 6 - 1 AS cluster FROM clicks)"


def assigned(long):
    return long.select(*KEYS).distinct().withColumn("cluster", (F.col("user_id") % 6 - 1).cast("int"))


def _text(pairs: str, field: str):
    shown = F.transform(pairs, lambda x: F.format_string("%s:%d", x[field], x["count"]))
    return F.array_join(shown, " ").alias(pairs)


def prof_sql(noise: bool = False, actions: int = 10, pages: int = 6) -> str:
    keep = "" if noise else "WHERE cluster >= 0"
    return f"""{ASG}, ts AS (SELECT cluster, session_id, token, split_part(token, '|', 1) AS pg, split_part(token, '|', 2) AS act FROM seq JOIN asg USING (session_id) {keep}),
    a0 AS (SELECT cluster, act, count(*) AS n FROM ts GROUP BY 1, 2), a1 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, act) AS r FROM a0 QUALIFY r <= {actions}),
    pg0 AS (SELECT cluster, pg, count(*) AS n FROM ts GROUP BY 1, 2), pg1 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, pg) AS r FROM pg0 QUALIFY r <= {pages}),
    a2 AS (SELECT cluster, array_agg(act ORDER BY r) AS acts, array_agg(n ORDER BY r) AS an, string_agg(concat(act, ':', CAST(n AS VARCHAR)), ' ' ORDER BY r) AS top_actions FROM a1 GROUP BY 1),
    pg2 AS (SELECT cluster, array_agg(pg ORDER BY r) AS pgs, array_agg(n ORDER BY r) AS pn, string_agg(concat(pg, ':', CAST(n AS VARCHAR)), ' ' ORDER BY r) AS page_dist FROM pg1 GROUP BY 1),
    prof AS (SELECT * FROM (SELECT cluster, count(DISTINCT session_id) AS "count" FROM ts GROUP BY 1) JOIN a2 USING (cluster) JOIN pg2 USING (cluster))"""


PROF = f"{SEQ}, {prof_sql()}"


def profiles_of(spark, sf):
    c, long = sequences_of(spark, sf)
    long = cut(long)
    return c, long, pf.cluster_profiles(long, assigned(long), KEYS)


@query("cluster_profiles", f"""{PROF} SELECT cluster, "count", top_actions, page_dist FROM prof""")
def cluster_profiles(spark, sf):
    return profiles_of(spark, sf)[2].select("cluster", "count", _text("top_actions", "action"), _text("page_dist", "page"))


@query("cluster_profiles_with_noise", f"""{SEQ}, {prof_sql(True, 5)} SELECT cluster, "count", top_actions, page_dist FROM prof""")
def cluster_profiles_with_noise(spark, sf):
    _, long = sequences_of(spark, sf)
    long = cut(long)
    out = pf.cluster_profiles(long, assigned(long), KEYS, actions=5, noise=True)
    return out.select("cluster", "count", _text("top_actions", "action"), _text("page_dist", "page"))


@query("profile_labels", f"""{PROF} SELECT cluster, concat('C', CAST(cluster AS VARCHAR), ':', array_to_string(acts[1:2], '+'), '/', pgs[1]) AS label FROM prof""")
def profile_labels(spark, sf):
    return profiles_of(spark, sf)[2].select("cluster", pf.profile_label().alias("label"))


def _share(*names: str) -> str:
    return f"(SELECT coalesce(sum(n), 0) FROM a1 WHERE a1.cluster = prof.cluster AND act IN {_in(names)}) / (SELECT sum(n) FROM a1 WHERE a1.cluster = prof.cluster)"


def _page(name: str) -> str:
    return f"(SELECT coalesce(sum(n), 0) FROM pg1 WHERE pg1.cluster = prof.cluster AND pg = '{name}') / (SELECT sum(n) FROM pg1 WHERE pg1.cluster = prof.cluster)"


_TELLING = f"(SELECT greatest(coalesce(sum(n), 0), 1) FROM a1 WHERE a1.cluster = prof.cluster AND act NOT IN {_in(pf.GENERIC_ACTIONS)})"


def _of_telling(*names: str) -> str:
    return f"(SELECT coalesce(sum(n), 0) FROM a1 WHERE a1.cluster = prof.cluster AND act IN {_in(names)}) / {_TELLING}"


TYPED = f"""typed AS (SELECT *, CASE WHEN {_share('ADD_CART', 'CLICK_BUY')} > 0.15 OR {_share('ADD_CART')} > 0.1 THEN '구매 결정형'
    WHEN {_share('SCROLL_PRICE', 'CHECK_PRICE')} > 0.2 THEN '가격 비교형' WHEN {_share('TAB_OUT', 'EXIT_BOUNCE')} > 0.25 THEN '탐색 중지 위험형'
    WHEN {_share('VIEW_REVIEW')} > 0.08 THEN '신중 탐색형' WHEN {_share('VIEW_IMAGE')} > 0.1 THEN '비주얼 탐색형'
    WHEN {_page('PRODUCT')} > 0.7 THEN '상품 집중형' WHEN {_page('HOME')} > 0.5 THEN '홈 체류형' ELSE '일반 탐색형' END AS name,
    CASE WHEN {_of_telling('ADD_CART', 'CLICK_BUY')} > 0.08 THEN '높음' WHEN {_of_telling('TAB_OUT', 'EXIT_BOUNCE', 'INACTIVE')} > 0.25 THEN '낮음' ELSE '중간' END AS intent FROM prof)"""


@query("type_names", f"{PROF}, {TYPED} SELECT cluster, name, intent FROM typed")
def type_names(spark, sf):
    return profiles_of(spark, sf)[2].select("cluster", pf.type_name().alias("name"), pf.infer_intent().alias("intent"))


@query("merge_profiles", f"""{PROF}, {TYPED}, h AS (SELECT name, sum("count") AS "count", string_agg(CAST(cluster AS VARCHAR), ' ' ORDER BY cluster) AS members FROM typed GROUP BY 1),
    ma AS (SELECT name, act, sum(n) AS n FROM a1 JOIN typed USING (cluster) GROUP BY 1, 2), mp AS (SELECT name, pg, sum(n) AS n FROM pg1 JOIN typed USING (cluster) GROUP BY 1, 2)
    SELECT row_number() OVER (ORDER BY "count" DESC, name) - 1 AS "rank", name, "count", members,
      (SELECT string_agg(concat(act, ':', CAST(n AS VARCHAR)), ' ' ORDER BY n DESC, act) FROM ma WHERE ma.name = h.name) AS top_actions,
      (SELECT string_agg(concat(pg, ':', CAST(n AS VARCHAR)), ' ' ORDER BY n DESC, pg) FROM mp WHERE mp.name = h.name) AS page_dist FROM h""")
def merge_profiles(spark, sf):
    out = pf.merge_profiles(cut(profiles_of(spark, sf)[2]))
    members = F.array_join(F.col("members").cast("array<string>"), " ").alias("members")
    return out.select("rank", "name", "count", members, _text("top_actions", "action"), _text("page_dist", "page"))


@query("significant_actions", f"""{PROF}, s AS (SELECT cluster, act, row_number() OVER (PARTITION BY cluster ORDER BY act IN {_in(pf.GENERIC_ACTIONS)}, r) AS q FROM a1)
    SELECT cluster, string_agg(act, ' ' ORDER BY q) AS actions FROM s WHERE q <= 7 GROUP BY 1""")
def significant_actions(spark, sf):
    acts = F.transform(pf.significant_actions(7), lambda x: x["action"])
    return profiles_of(spark, sf)[2].select("cluster", F.array_join(acts, " ").alias("actions"))


def _overlap(list_: str, rules) -> str:
    return " ".join(f"WHEN list_has_any({list_}, [{', '.join(repr(n) for n in names)}]) THEN '{name}'" for name, names in rules)


NAMED = f"""n0 AS (SELECT *, CASE {_overlap('acts[1:3]', pf.LEADING_NAMES)} ELSE '{pf.UNKNOWN_CUSTOMER}' END AS base,
    CASE {_overlap('acts', pf.QUALIFIERS)} {_overlap('pgs', pf.PAGE_QUALIFIERS)} ELSE '{pf.NO_QUALIFIER}' END AS qual FROM prof),
    n1 AS (SELECT *, count(*) OVER (PARTITION BY base) AS shared, row_number() OVER (PARTITION BY base, qual ORDER BY cluster) AS nth FROM n0),
    named AS (SELECT *, CASE WHEN shared = 1 THEN base WHEN nth = 1 THEN concat(base, ' · ', qual) ELSE concat(base, ' · ', qual, ' ', CAST(nth AS VARCHAR)) END AS label FROM n1)"""


@query("unique_labels", f"{PROF}, {NAMED} SELECT cluster, label FROM named")
def unique_labels(spark, sf):
    return pf.unique_labels(profiles_of(spark, sf)[2]).select("cluster", "label")


_STATUS = """CASE WHEN "count" < 5 OR ("count" / total > 0 AND "count" / total < 0.05) THEN 'weak' ELSE 'verified' END"""


@query("cluster_validation", f"""{PROF}, {NAMED}, t AS (SELECT *, sum("count") OVER () * 4 AS total FROM named)
    SELECT cluster, label, {_STATUS} AS status, CASE {_STATUS} WHEN 'weak' THEN '검증 필요' ELSE '검증 통과' END AS status_label,
      CASE WHEN "count" / total > 0 AND "count" / total < 0.05 THEN 1 ELSE 0 END + CASE WHEN "count" < 5 THEN 1 ELSE 0 END AS reasons,
      round("count" / total * 100, 1) AS session_share FROM t""")
def cluster_validation(spark, sf):
    profiles = cut(profiles_of(spark, sf)[2])
    # measured against four times the sessions, so that some clusters come out small
    total = profiles.agg((F.sum("count") * 4).alias("n")).select("n").scalar()
    out = pf.assemble(profiles, total)
    return out.select("cluster", "label", "status", "status_label", F.size("reasons").alias("reasons"), "session_share")


@query("summary_texts", f"""{PROF} SELECT cluster, concat(array_to_string(list_transform(acts[1:3], lambda a: coalesce({_map('a', pf.SCREEN_ACTIONS)},
    lower(replace(a, '_', ' ')))), ', '), ' 중심으로 묶인 고객 유형입니다.') AS summary,
    '이 유형의 주요 행동이 많은 화면을 점검하고, 다음 행동으로 이어지는 안내 문구를 보강하세요.' AS advice FROM prof""")
def summary_texts(spark, sf):
    return profiles_of(spark, sf)[2].select("cluster", pf.summary_text().alias("summary"), pf.advice_text().alias("advice"))


@query("quality_summary", f"""{PROF}, nz AS (SELECT count(*) AS noise FROM (SELECT DISTINCT session_id FROM seq) JOIN asg USING (session_id) WHERE cluster < 0),
    t AS (SELECT *, sum("count") OVER () AS total FROM prof), s AS (SELECT *, {_STATUS} AS st FROM t)
    SELECT CASE WHEN any_value(noise) > sum("count") THEN sum("count") + any_value(noise) ELSE sum("count") END AS sample_count, any_value(noise) AS noise_count,
      count(*) FILTER (st = 'verified') AS verified_clusters, count(*) FILTER (st = 'weak') AS weak_clusters, 0 AS insufficient_clusters, count(*) AS visible_clusters,
      round(any_value(noise) / sum("count"), 4) AS noise_rate, sum("count") AS clustered_session_count, 0.48 AS silhouette, CAST(NULL AS DOUBLE) AS davies_bouldin,
      0.9 AS stability, 'measured on normalised vectors' AS note FROM s, nz""")
def quality_summary(spark, sf):
    _, long, profiles = profiles_of(spark, sf)
    profiles = cut(profiles)
    total = profiles.agg(F.sum("count").alias("n")).select("n").scalar()
    noise = assigned(long).agg(F.count_if(F.col("cluster") < 0).alias("n")).select("n").scalar()
    run = {"clustered_session_count": total, "silhouette": F.lit(0.48), "stability": F.lit(0.9), "note": F.lit("measured on normalised vectors")}
    return pf.quality_summary(pf.cluster_validation(profiles, total), noise, measures=run)


@query("profile_stability", f"""{PROF}, o AS (SELECT cluster AS oc, list_distinct(list_concat(list_transform(acts[3:7], lambda a: concat('A:', a)), list_transform(pgs[1:3], lambda p: concat('P:', p)))) AS t FROM prof),
    n AS (SELECT cluster, list_distinct(list_concat(list_transform(acts[1:5], lambda a: concat('A:', a)), list_transform(pgs[1:5], lambda p: concat('P:', p)))) AS t FROM prof)
    SELECT cluster, round(max(len(list_intersect(n.t, o.t)) / (len(n.t) + len(o.t) - len(list_intersect(n.t, o.t)))), 4) AS stability FROM n, o GROUP BY 1""")
def profile_stability(spark, sf):
    new = cut(profiles_of(spark, sf)[2])
    # the earlier run: the same clusters led by other actions
    old = new.withColumns({"top_actions": F.slice("top_actions", 3, 5), "page_dist": F.slice("page_dist", 1, 3)})
    return pf.profile_stability(new, old).withColumn("stability", F.round("stability", 4))


_SUMMARY = f"{SEQ}, {ASG}, ln AS (SELECT session_id, cluster, count(*) AS length FROM seq JOIN asg USING (session_id) GROUP BY 1, 2)"


@query("cluster_summary", f"""{_SUMMARY} SELECT cluster, count(*) AS sessions, round(avg(length), 2) AS avg_length, min(length) AS min_length, max(length) AS max_length FROM ln GROUP BY 1""")
def cluster_summary(spark, sf):
    _, long = sequences_of(spark, sf)
    long = cut(long)
    return pf.cluster_summary(long, assigned(long), KEYS)[0]


def _top_sql(kind: str, value: str) -> str:
    return f"""SELECT cluster, '{kind}' AS kind, value, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, value) AS "rank"
      FROM (SELECT cluster, {value} AS value, count(*) AS n FROM seq JOIN asg USING (session_id) GROUP BY 1, 2) QUALIFY "rank" <= 10"""


@query("cluster_top_lists", f"""{SEQ}, {ASG} {_top_sql('token', 'token')} UNION ALL {_top_sql('action', "split_part(token, '|', 2)")} UNION ALL {_top_sql('page', "split_part(token, '|', 1)")}""")
def cluster_top_lists(spark, sf):
    _, long = sequences_of(spark, sf)
    long = cut(long)
    return pf.cluster_summary(long, assigned(long), KEYS)[1].select("cluster", "kind", "value", "n", "rank")


@query("cluster_samples", f"""{_SUMMARY} SELECT session_id, cluster, length, row_number() OVER (PARTITION BY cluster ORDER BY session_id) AS "rank" FROM ln QUALIFY "rank" <= 3""")
def cluster_samples(spark, sf):
    _, long = sequences_of(spark, sf)
    long = cut(long)
    return pf.cluster_summary(long, assigned(long), KEYS)[2].drop("user_id")


_CHURN = "churn AS (SELECT session_id, CAST(NOT bool_or(event_type IN ('add_to_cart', 'purchase_click')) AS INTEGER) AS is_churned FROM clicks GROUP BY 1)"


@query("cluster_churn", f"""{_SUMMARY}, {_CHURN} SELECT cluster, count(*) AS sessions, round(avg(length), 1) AS avg_length, round(avg(is_churned), 4) AS churn_rate, avg(is_churned) > 0.6 AS at_risk
    FROM ln JOIN churn USING (session_id) GROUP BY 1""")
def cluster_churn(spark, sf):
    c, long = sequences_of(spark, sf)
    long = cut(long)
    return pf.cluster_churn(long, assigned(long), features.churn_labels(c.df, KEYS), KEYS)[0]


@query("site_clusters", f"""{PROF}, {NAMED}, site AS (SELECT DISTINCT session_id FROM clicks WHERE origin = 'https://site1'), lv AS (SELECT session_id, max(received_at) AS last_at FROM clicks
      WHERE origin = 'https://site1' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 120),
    cn AS (SELECT cluster, count(*) AS "count" FROM lv JOIN asg USING (session_id) WHERE cluster >= 0 GROUP BY 1)
    SELECT cn.cluster, cn."count", top_actions FROM cn LEFT JOIN prof USING (cluster)""")
def site_clusters(spark, sf):
    c, long, profiles = profiles_of(spark, sf)
    site = c.df.where(F.col("origin") == "https://site1").groupBy(*KEYS).agg(F.max("received_at").alias("last_at"))
    newest = site.orderBy(F.desc("last_at"), "session_id").limit(120)
    labelled = newest.withColumn("cluster", (F.col("user_id") % 6 - 1).cast("int"))
    out, _ = pf.site_clusters(labelled, profiles, labelled.agg(F.count(F.lit(1)).alias("n")).scalar())
    return out.select("cluster", "count", _text("top_actions", "action"))


# --- funnel --------------------------------------------------------------------------------------------

_STAGE = f"""stg AS (SELECT session_id, max(CASE WHEN split_part(token, '|', 2) = 'CLICK_BUY' THEN 4 WHEN split_part(token, '|', 1) = 'CHECKOUT' THEN 3
    WHEN split_part(token, '|', 2) IN ('ADD_CART', 'ENTER_CART') OR split_part(token, '|', 1) = 'CART' THEN 2
    WHEN split_part(token, '|', 1) = 'PRODUCT' OR split_part(token, '|', 2) = 'VIEW_PRODUCT' THEN 1 ELSE 0 END) AS stage FROM seq GROUP BY 1)"""
_FUNNEL = f"""{PROF}, {TYPED}, {_STAGE}, nm AS (SELECT session_id, stage, coalesce(name, '미분류') AS name FROM stg LEFT JOIN asg USING (session_id) LEFT JOIN typed USING (cluster)),
    lv AS (SELECT l AS level, count(*) FILTER (stage >= l) AS reach FROM nm, (SELECT unnest(range(5)) AS l) GROUP BY 1),
    dr AS (SELECT level, reach, lag(reach) OVER (ORDER BY level) AS before FROM lv)"""


def stages_of(spark, sf):
    _, long, profiles = profiles_of(spark, sf)
    names = profiles.select("cluster", pf.type_name().alias("name"))
    return rp.named_stages(rp.furthest_stage(long, KEYS), assigned(long), names, KEYS)


@query("furthest_stage", f"{SEQ}, {_STAGE} SELECT * FROM stg")
def furthest_stage(spark, sf):
    return rp.furthest_stage(sequences_of(spark, sf)[1], KEYS).drop("user_id")


@query("session_types", f"{_FUNNEL} SELECT session_id, stage, name FROM nm")
def session_types(spark, sf):
    return stages_of(spark, sf).select("session_id", "stage", "name")


@query("funnel", f"""{_FUNNEL} SELECT CASE level WHEN 0 THEN '방문' WHEN 1 THEN '상품 조회' WHEN 2 THEN '장바구니' WHEN 3 THEN '결제 도달' ELSE '구매 클릭' END AS stage,
      level, reach, CAST(round_even(reach * 100 / max(reach) OVER (), 0) AS BIGINT) AS rate, before - reach AS "drop",
      CAST(round_even((before - reach) * 100 / before, 0) AS BIGINT) AS drop_rate,
      level = (SELECT level FROM dr WHERE before IS NOT NULL ORDER BY before - reach DESC, level LIMIT 1) AS biggest FROM dr""")
def funnel(spark, sf):
    return rp.funnel(rp.stage_counts(stages_of(spark, sf)))


@query("funnel_by_type", f"""{_FUNNEL}, lk AS (SELECT level - 1 AS l FROM dr WHERE before IS NOT NULL ORDER BY before - reach DESC, level LIMIT 1),
    b AS (SELECT name, count(*) AS n, CAST(round_even(count(*) FILTER (stage >= 2) * 100 / count(*), 0) AS BIGINT) AS cart_rate,
      CAST(round_even(count(*) FILTER (stage >= 3) * 100 / count(*), 0) AS BIGINT) AS chk_rate, CAST(round_even(count(*) FILTER (stage >= 4) * 100 / count(*), 0) AS BIGINT) AS buy_rate,
      count(*) FILTER (stage = (SELECT l FROM lk)) AS stall_leak FROM nm GROUP BY 1)
    SELECT *, stall_leak > 0 AND name = (SELECT name FROM b ORDER BY (name <> '미분류' AND stall_leak > 0) DESC, stall_leak DESC, name LIMIT 1) AS leak_type FROM b""")
def funnel_by_type(spark, sf):
    return rp.funnel_by_type(rp.stage_counts(stages_of(spark, sf)))


@query("type_intents", f"""{_FUNNEL}, b AS (SELECT name, round_even(count(*) FILTER (stage >= 4) * 100 / count(*), 0) AS buy FROM nm GROUP BY 1),
    m AS (SELECT round_even(count(*) FILTER (stage >= 4) * 100 / count(*), 0) AS mean FROM nm)
    SELECT name, CASE WHEN buy >= greatest(mean * 1.2, 15) THEN '높음' WHEN buy <= mean * 0.6 THEN '낮음' ELSE '중간' END AS intent FROM b, m""")
def type_intents(spark, sf):
    counts = cut(rp.stage_counts(stages_of(spark, sf)))
    mean = rp.funnel(counts).where("level = 4").select("rate").scalar()
    return rp.funnel_by_type(counts).select("name", rp.intent_from_funnel(F.col("buy_rate"), mean).alias("intent"))


@query("prototype_names", f"""{CLICKS} SELECT user_id % 3 AS cluster, CASE WHEN count(*) FILTER (event_type = 'tab_exit') > 50 AND count(*) FILTER (event_type = 'inactivity') > 50 THEN 'Distracted (주의 분산형)'
    WHEN count(*) FILTER (event_type = 'input_change') > 30 OR count(*) FILTER (event_type = 'click') > 50 THEN 'Explorer (탐색형)' ELSE 'Other' END AS name FROM clicks GROUP BY 1""")
def prototype_names(spark, sf):
    e = Clicks(spark, sf).df
    names = ("scroll_speed", "tab_exit", "inactivity", "input_change", "click")
    counts = e.groupBy((F.col("user_id") % 3).alias("cluster")).agg(*(F.count_if(F.col("event_type") == n).alias(n) for n in names))
    return counts.select("cluster", pf.prototype_name({n: F.col(n) for n in names}).alias("name"))


@query("sql_views", f"""{SEQ}, {_STAGE}, x AS (SELECT session_id, count(*) AS n_events, (array_agg(pathname ORDER BY "timestamp" DESC, event_id DESC))[1] AS exit_page FROM clicks GROUP BY 1),
    l AS (SELECT session_id, count(*) AS n_tokens FROM seq GROUP BY 1)
    SELECT stage, count(*) AS sessions, sum(n_tokens) AS tokens, sum(n_events) AS events, count(*) FILTER (exit_page = '/cart') AS left_in_cart
    FROM stg JOIN l USING (session_id) JOIN x USING (session_id) GROUP BY 1""")
def sql_views(spark, sf):
    """A report in SQL over the operators' views."""
    from pathloom.views import register_views

    register_views(Clicks(spark, sf).df, KEYS, "pathloom_", ["session_stages", "session_sequences", "exit_records"])
    return spark.sql("""
        SELECT s.stage, count(*) AS sessions, sum(t.n) AS tokens, sum(e.n) AS events, count_if(x.exit_page = '/cart') AS left_in_cart
        FROM pathloom_session_stages s JOIN pathloom_exit_records x USING (user_id, session_id)
        JOIN (SELECT session_id, count(*) AS n FROM pathloom_session_sequences GROUP BY session_id) t USING (session_id)
        JOIN (SELECT session_id, count(*) AS n FROM pathloom_events GROUP BY session_id) e USING (session_id)
        GROUP BY s.stage""")
