"""Origins, hosts, tracking parameters and first-touch attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.rules import blank_to_null, first_match, lowered

# Parameters that say how a visitor came, not which page was seen.
TRACKING_PARAMS = [
    "icid",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "igshid",
    "n_media", "n_query", "n_ad_group", "NaPm",
]

# Payment hosts, a return from which is no new visit.
PAYMENT_HOSTS = [
    "inicis", "kcp", "nicepay", "kgmobilians", "settlebank",
    "tosspayments", "toss.im", "kakaopay", "naverpay", "payco",
    "smartro", "ksnet", "allat", "kicc", "danal", "eximbay",
    "pay.naver.com", "paypal",
]

# Apps that open links in their own browser, by user agent.
IN_APP_BROWSERS = [
    ("Instagram", "(?i)Instagram"),
    ("KakaoTalk", "(?i)KAKAOTALK"),
    ("Naver", r"(?i)NAVER\(inapp"),
    ("Daum", "(?i)DaumApps|daumcafe"),
    ("Facebook", "(?i)FBAN|FBAV|FB_IAB"),
    ("Line", "(?i)Line/"),
    ("Threads", "(?i)Threads"),
    ("TikTok", "(?i)TikTok|Musical_ly"),
]

# Display names of sources.
SOURCE_NAMES = [
    ("Notion", "notion"),
    ("Instagram", "insta"),
    ("Threads", "threads"),
    ("Facebook", "facebook|fban"),
    ("GitHub", "github"),
    ("Kakao", "kakao"),
    ("Google", "google"),
    ("Naver", "naver"),
    ("Daum", "daum"),
    ("TikTok", "tiktok"),
    ("YouTube", "youtube"),
    ("Line", "line"),
]
DIRECT_NAME = "직접 방문"

# Device, system and browser by user agent.
DEVICES = [("tablet", "(?i)Tablet|iPad"), ("mobile", "(?i)Mobi|Android|iPhone|iPod")]
SYSTEMS = [
    ("windows", "(?i)Windows"),
    ("macos", "(?i)Mac OS X"),
    ("android", "(?i)Android"),
    ("ios", "(?i)iPhone|iPad|iPod"),
    ("linux", "(?i)Linux"),
]
BROWSERS = [
    ("edge", "(?i)Edg/"),
    ("opera", "(?i)OPR/"),
    ("chrome", "(?i)Chrome/"),
    ("firefox", "(?i)Firefox/"),
    ("safari", "(?i)Safari/"),
]

UTM_FIELDS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]


def normalize_origin(value: Column) -> Column:
    return F.regexp_replace(lowered(value), "/+$", "")


def origin_filter(column: Column, origin: str | None) -> Column:
    """Rows of one site; the two stored spellings keep the filter a pushed-down IN."""
    if not origin:
        return F.lit(True)
    base = origin.strip().lower().rstrip("/")
    return column.isin(base, base + "/")


def origin_matches(column: Column, origin: str | None) -> Column:
    """Rows of one site in any upper/lower-case spelling, with at most one closing slash."""
    if not origin:
        return F.lit(True)
    return F.regexp_replace(F.lower(column), "/$", "") == F.lit(origin.strip().lower().rstrip("/"))


def collect_origin(value: Column) -> Column:
    """Site of a delivery: scheme and host without the mobile prefix, anything unparsable as it is."""
    authority = F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]+)", 2)
    scheme = F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    host = F.regexp_replace(authority, "(?i)^m\\.", "")
    return F.when(authority == "", value).otherwise(F.lower(F.concat(scheme, host)))


def site_key(value: Column) -> Column:
    """File-safe name of a site."""
    return F.regexp_replace(
        F.regexp_replace(normalize_origin(value), "^https?://", ""), "[^a-z0-9._-]+", "_"
    )


def clean_tracking_url(url: Column) -> Column:
    """Drop tracking parameters, and the question mark when none is left; keep the fragment."""
    names = "|".join(TRACKING_PARAMS)
    gone = F.regexp_replace(url, rf"(?<=[?&])(?:{names})(?:=[^&#]*)?(?=&|#|$)", "")
    squeezed = F.regexp_replace(F.regexp_replace(gone, "&{2,}", "&"), r"\?&+", "?")
    return F.regexp_replace(squeezed, r"[?&]+(?=#|$)", "")


def clean_fragment_url(url: Column) -> Column:
    """Drop the fragment and path parameters, keep the query."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    return F.regexp_replace(bare, r";[^/?]*(?=\?|$)", "")


def replace_path(url: Column, path: Column) -> Column:
    """Scheme and host of ``url`` with another path; as it is when the path is not absolute."""
    base = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    return F.when(path.startswith("/"), F.concat(base, path)).otherwise(url)


def host_of(url: Column) -> Column:
    """Host without ``www.``, lower-case; '' when there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.regexp_replace(host, r"(?i)^www\.", ""))


def utm_params(url: Column) -> list[Column]:
    """The five campaign parameters, '' when absent."""
    return [
        F.coalesce(F.url_decode(blank_to_null(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))), F.lit("")).alias(name)
        for name in UTM_FIELDS
    ]


def ignored_referrer(host: Column, self_host: Column) -> Column:
    """Own site (either one a subdomain of the other) or a payment host."""
    own = (
        (host == self_host)
        | self_host.endswith(F.concat(F.lit("."), host))
        | host.endswith(F.concat(F.lit("."), self_host))
    )
    payment = host.rlike("|".join(h.replace(".", r"\.") for h in PAYMENT_HOSTS))
    return (host == "") | own | payment


def in_app_browser(user_agent: Column) -> Column:
    return first_match(user_agent, IN_APP_BROWSERS, "")


def device_type(user_agent: Column) -> Column:
    return first_match(user_agent, DEVICES, "desktop")


def os_type(user_agent: Column) -> Column:
    return first_match(user_agent, SYSTEMS, "unknown")


def browser_type(user_agent: Column) -> Column:
    return first_match(user_agent, BROWSERS, "unknown")


def channel(utm_source: Column, in_app: Column, referrer_host: Column, ignored: Column) -> Column:
    """Campaign, else in-app browser, else foreign referrer, else direct."""
    return F.coalesce(
        blank_to_null(utm_source),
        blank_to_null(in_app),
        F.when(~ignored, referrer_host),
        F.lit("direct"),
    )


def pretty_source(raw: Column) -> Column:
    value = lowered(raw)
    named = first_match(value, SOURCE_NAMES, F.regexp_replace(raw, r"(?i)^www\.", ""))
    return F.when(value.isin("", "direct"), F.lit(DIRECT_NAME)).otherwise(named)


def source_name(channel_: Column, in_app: Column, utm_source: Column, referrer: Column) -> Column:
    """Display name of a session's source."""
    return pretty_source(
        F.coalesce(blank_to_null(channel_), blank_to_null(in_app), blank_to_null(utm_source), referrer_host(referrer))
    )


def referrer_host(referrer: Column) -> Column:
    """Host and port of a referrer without ``www.``; '' when there is none."""
    host = F.regexp_extract(F.coalesce(referrer, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def product_id_from_url(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(url, r"(?i)/(?:product|p|item|goods|shop)/([^/?#]+)", 1))
