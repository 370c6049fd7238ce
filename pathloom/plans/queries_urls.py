"""Registered queries: URLs, attribution, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions import carts, pages, tokens as tk, urls
from pathloom.functions.payload import event_number
from pathloom.plans.fixtures import clicks_sql, raw_clicks, table
from pathloom.plans.queries_sequences import _case, _in, _map
from pathloom.plans.registry import query

CLICKS = "WITH " + clicks_sql()
_PARAMS = "|".join(urls.TRACKING_PARAMS)
# parameters are split, filtered and joined again: another way than the query's
_CLEAN = f"""concat(split_part(split_part(u, '#', 1), '?', 1),
  CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END, CASE WHEN contains(u, '#') THEN concat('#', split_part(u, '#', 2)) ELSE '' END)"""
_KEPT = f"list_filter(string_split(split_part(split_part(u, '#', 1), '?', 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({_PARAMS})(=|$)'))"
_AUTH = "split_part(split_part(split_part(split_part(u, '://', 2), '/', 1), '?', 1), '#', 1)"


@query("clean_urls", f"""WITH a AS (SELECT page_id, concat(url, CASE WHEN contains(url, '?') THEN '&gclid=1' ELSE '' END) AS u FROM pages), b AS (SELECT *, {_KEPT} AS kept FROM a)
    SELECT page_id, {_CLEAN} AS clean, split_part(u, '#', 1) AS no_fragment, regexp_replace({_AUTH}, '^www\\.', '') AS host,
      concat(split_part(u, '://', 1), '://', regexp_replace({_AUTH}, '^m\\.', '')) AS origin,
      regexp_replace(regexp_replace(regexp_replace(lower(u), '/+$', ''), '^https?://', ''), '[^a-z0-9._-]+', '_', 'g') AS site_key FROM b""")
def clean_urls(spark, sf):
    p = table(spark, sf, "pages")
    u = F.concat("url", F.when(F.col("url").contains("?"), "&gclid=1").otherwise(""))
    p = p.withColumn("u", u)
    return p.select(
        "page_id", urls.clean_tracking_url(F.col("u")).alias("clean"), urls.clean_fragment_url(F.col("u")).alias("no_fragment"),
        urls.host_of(F.col("u")).alias("host"), urls.collect_origin(F.col("u")).alias("origin"), urls.site_key(F.col("u")).alias("site_key"),
    )


@query("utm_params", """SELECT page_id, coalesce(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source,
    regexp_extract(url, '[?&]utm_medium=([^&#]*)', 1) AS utm_medium FROM pages""")
def utm_params(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", *urls.utm_params(F.col("url"))).select("page_id", "utm_source", "utm_medium")


@query("product_ids", f"""{CLICKS} SELECT event_id, nullif(regexp_extract(page_url, '/(product|p|item|goods|shop)/([^/?#]+)', 2, 'i'), '') AS product_id FROM clicks""")
def product_ids(spark, sf):
    return raw_clicks(spark, sf).select("event_id", urls.product_id_from_url(F.col("page_url")).alias("product_id"))


_UA = ("CASE event_id % 9 WHEN 0 THEN 'Mozilla/5.0 (iPhone; CPU) Instagram 12' WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/1 Safari/1 Edg/9' "
       "WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 9) KAKAOTALK 8 Chrome/99' WHEN 3 THEN 'Mozilla/5.0 (iPad; CPU OS) NAVER(inapp; search)' "
       "WHEN 4 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10) Firefox/88' WHEN 5 THEN 'FB_IAB/FB4A' WHEN 6 THEN 'Line/11 Mobile' "
       "WHEN 7 THEN 'Opera OPR/8 Linux' ELSE 'curl' END")


@query("attribution", f"""{CLICKS}, h AS (SELECT event_id, utm_source, {_UA} AS ua, coalesce(referrer, '') AS ref, regexp_replace(regexp_extract(coalesce(referrer, ''), '^https?://([^/?#:]+)', 1), '^www\\.', '') AS host,
      regexp_extract(origin, '//([^/]+)', 1) AS self FROM clicks),
    g AS (SELECT *, host = '' OR host = self OR ends_with(self, concat('.', host)) OR ends_with(host, concat('.', self)) OR regexp_matches(host, '{"|".join(urls.PAYMENT_HOSTS).replace(".", chr(92) + ".")}') AS ignored,
      CASE WHEN contains(ua, 'Instagram') THEN 'Instagram' WHEN contains(ua, 'KAKAOTALK') THEN 'KakaoTalk' WHEN contains(ua, 'NAVER(inapp') THEN 'Naver' WHEN contains(ua, 'FB_IAB') THEN 'Facebook'
        WHEN contains(ua, 'Line/') THEN 'Line' ELSE '' END AS in_app FROM h)
    SELECT event_id, host, ignored, in_app, coalesce(nullif(utm_source, ''), nullif(in_app, ''), CASE WHEN NOT ignored THEN host END, 'direct') AS channel,
      CASE WHEN contains(ua, 'iPad') THEN 'tablet' WHEN regexp_matches(ua, 'Mobi|Android|iPhone') THEN 'mobile' ELSE 'desktop' END AS device_type,
      CASE WHEN contains(ua, 'Windows') THEN 'windows' WHEN contains(ua, 'Mac OS X') THEN 'macos' WHEN contains(ua, 'Android') THEN 'android' WHEN regexp_matches(ua, 'iPhone|iPad') THEN 'ios'
        WHEN contains(ua, 'Linux') THEN 'linux' ELSE 'unknown' END AS os_type,
      CASE WHEN contains(ua, 'Edg/') THEN 'edge' WHEN contains(ua, 'OPR/') THEN 'opera' WHEN contains(ua, 'Chrome/') THEN 'chrome' WHEN contains(ua, 'Firefox/') THEN 'firefox' ELSE 'unknown' END AS browser_type FROM g""")
def attribution(spark, sf):
    e = raw_clicks(spark, sf).withColumns({"ua": F.expr(_UA), "host": urls.host_of(F.col("referrer")), "self": urls.host_of(F.col("origin"))})
    e = e.withColumns({"ignored": urls.ignored_referrer(F.col("host"), F.col("self")), "in_app": urls.in_app_browser(F.col("ua"))})
    return e.select(
        "event_id", "host", "ignored", "in_app", urls.channel(F.col("utm_source"), F.col("in_app"), F.col("host"), F.col("ignored")).alias("channel"),
        urls.device_type(F.col("ua")).alias("device_type"), urls.os_type(F.col("ua")).alias("os_type"), urls.browser_type(F.col("ua")).alias("browser_type"),
    )


_ROLE = "CASE k % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'PRODUCT_DETAIL' WHEN 2 THEN 'ORDER_BASKET' WHEN 3 THEN 'UNHEARD' ELSE NULL END"
_TEMPLATE = "CASE k % 5 WHEN 0 THEN '/order/order_result.html' WHEN 1 THEN '/order/basket.html' WHEN 2 THEN '/product/list.html' WHEN 3 THEN '/nothing' ELSE NULL END"


@query("platform_pages", f"""{CLICKS}, a AS (SELECT event_id, {_ROLE} AS r, {_TEMPLATE} AS t FROM clicks)
    SELECT event_id, CASE upper(r) WHEN 'MAIN' THEN 'HOME' WHEN 'PRODUCT_DETAIL' THEN 'PRODUCT' WHEN 'ORDER_BASKET' THEN 'CART' ELSE
      CASE WHEN contains(t, 'order_result') THEN 'ORDER_SUCCESS' WHEN contains(t, 'basket') THEN 'CART' WHEN contains(t, '/product/list') THEN 'CATEGORY' ELSE 'UNKNOWN' END END AS page FROM a""")
def platform_pages(spark, sf):
    return raw_clicks(spark, sf).select("event_id", pages.platform_page(F.expr(_ROLE), F.expr(_TEMPLATE)).alias("page"))


@query("section_names", f"""SELECT doc_id, {_case('lower(text)', pages.SECTION_NAMES, 'NULL')} AS section, {_case('text', pages.SUBSECTION_NAMES, 'NULL')} AS subsection,
    {_case('lower(text)', tk.TEXT_SEMANTICS, 'NULL')} AS semantic, {_case('lower(text)', pages.AREAS, "'UNKNOWN_AREA'")} AS area,
    substr(regexp_replace(regexp_replace(lower(trim(source || ' ' || lang)), '\\s+', '_', 'g'), '[^a-z0-9_가-힣]', '', 'g'), 1, 40) AS name FROM documents""")
def section_names(spark, sf):
    d = table(spark, sf, "documents").withColumn("__t", F.lower("text"))
    return d.select(
        "doc_id", pages.section_name(F.col("text"), F.col("__t")).alias("section"), pages.subsection_name(F.col("text"), F.col("__t")).alias("subsection"),
        tk.semantic_in_text(F.col("__t")).alias("semantic"), pages.area_in_text(F.col("__t")).alias("area"),
        pages.normalize_section_name(F.concat_ws(" ", "source", "lang")).alias("name"),
    )


@query("page_sections", f"""SELECT page_id, {_case("lower(html)", pages.SECTION_NAMES, 'NULL')} AS section FROM pages""")
def page_sections(spark, sf):
    p = table(spark, sf, "pages").withColumn("__t", F.lower("html"))
    return p.select("page_id", pages.section_name(F.col("html"), F.col("__t")).alias("section"))


@query("event_numbers", f"""{CLICKS} SELECT event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in __import__('pathloom.functions.payload', fromlist=['x']).EVENT_NUMBERS.items())} ELSE 0 END AS event_token FROM clicks""")
def event_numbers(spark, sf):
    return raw_clicks(spark, sf).select("event_id", event_number(F.col("event_type")).alias("event_token"))


_TEXT = "CASE event_id % 7 WHEN 0 THEN 'Remove from cart' WHEN 1 THEN '삭제' WHEN 2 THEN '전체 삭제' WHEN 3 THEN '×' WHEN 4 THEN '바로 구매' WHEN 5 THEN '주문내역' ELSE 'Buy now' END"


@query("cart_clicks", f"""{CLICKS}, a AS (SELECT event_id, {_TEXT} AS t, k % 2 = 0 AS c FROM clicks)
    SELECT event_id, CASE WHEN t = 'Remove from cart' THEN 'explicit' WHEN c AND t IN ('삭제', '전체 삭제', '×') THEN 'in_cart' END AS kind, t IN ('바로 구매', 'Buy now') AS buys FROM a""")
def cart_clicks(spark, sf):
    e = raw_clicks(spark, sf).withColumn("t", F.expr(_TEXT))
    return e.select("event_id", carts.cart_remove_kind(F.col("t"), F.lit(""), F.col("k") % 2 == 0).alias("kind"), carts.is_purchase_text(F.col("t")).alias("buys"))


@query("buckets", """SELECT event_id, CASE WHEN value * 300 <= 5000 THEN 'DWELL_SHORT' WHEN value * 300 <= 20000 THEN 'DWELL_MEDIUM' ELSE 'DWELL_LONG' END AS dwell,
    CASE WHEN value <= 30 THEN 'SCROLL_LOW' WHEN value <= 70 THEN 'SCROLL_MID' ELSE 'SCROLL_HIGH' END AS scroll, CASE WHEN value * 200 <= 5000 THEN 'HOVER_SHORT' ELSE 'HOVER_LONG' END AS hover,
    CASE WHEN event_id % 4 <= 1 THEN 'REVISIT_ONCE' ELSE 'REVISIT_MULTI' END AS revisit, CAST(floor(value * 20 / 500) * 500 AS BIGINT) AS px FROM events""")
def buckets(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", tk.dwell_bucket(v * 300).alias("dwell"), tk.scroll_bucket(v).alias("scroll"), tk.hover_bucket(v * 200).alias("hover"),
        tk.revisit_bucket(F.col("event_id") % 4).alias("revisit"), pages.scroll_bucket_px(v * 20).alias("px"),
    )


@query("live_tokens", f"""{CLICKS}, a AS (SELECT event_id, event_type, {_case("lower(concat(pathname, ' ', page_url))", pages.SIMPLE_PAGES, "'home'")} AS pg FROM clicks)
    SELECT event_id, concat({_map('pg', tk.LIVE_PAGES)}, '|', CASE WHEN upper(event_type) IN {_in(tk.LIVE_SEMANTICS)} THEN upper(event_type) ELSE 'CLICK_ELEMENT' END, '|NONE') AS token FROM a""")
def live_tokens(spark, sf):
    page = pages.simple_page(F.col("pathname"), F.col("page_url"))
    return raw_clicks(spark, sf).select("event_id", tk.live_token(F.upper("event_type"), page).alias("token"))
