"""From an event and where it happened to a ``PAGE|SEMANTIC|CONTEXT`` token.

Events fall into families. A family takes its semantic from a fixed table, keyed by event or by area,
and its context from one bucket. Null means the event leaves no token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.pages import AREAS
from pathloom.functions.rules import Rules, blank_to_null, first_in_text, first_match, lookup, lowered

# Raw events that never reach a sequence, and events that only move the state.
IGNORED_EVENTS = ["mouse_move", "scroll_speed", "scroll_stop", "scroll_direction_change", "time_to_first_click"]
CONTEXT_ONLY_EVENTS = [
    "section_enter", "section_exit", "section_transition", "section_revisit",
    "subsection_enter", "subsection_exit", "subsection_revisit",
]

ENTER_EVENTS = ["section_enter", "subsection_enter"]
REVISIT_EVENTS = ["section_revisit", "subsection_revisit"]
# Events that always leave a token, whose semantic depends on where they happen.
FAMILY_EVENTS = [
    "navigation", "session_end", "scroll_depth", "scroll_milestone", "subsection_dwell", "hover_dwell", "hover", "click",
]

# One semantic per event.
EVENT_SEMANTICS = {
    "session_start": "START_SESSION",
    "bounce": "EXIT_BOUNCE",
    "add_to_cart": "ADD_CART",
    "remove_from_cart": "REMOVE_CART",
    "purchase_click": "CLICK_BUY",
    "cart_abandon_flag": "CART_ABANDON",
    "product_click": "VIEW_PRODUCT",
    "option_select": "CHECK_SIZE",
    "option_change": "CHANGE_OPTION",
    "quantity_change": "CHANGE_QUANTITY",
    "review_click": "VIEW_REVIEW",
    "review_image_click": "VIEW_REVIEW",
    "review_page_change": "EXPAND_REVIEW",
    "review_scroll": "SCROLL_REVIEW",
    "review_area_scroll": "SCROLL_REVIEW",
    "image_zoom": "ZOOM_IMAGE",
    "image_slide": "VIEW_IMAGE",
    "video_play": "WATCH_VIDEO",
    "video_watch_pct": "WATCH_VIDEO",
    "search_use": "SEARCH_USE",
    "field_focus": "START_INPUT",
    "input_change": "EDIT_INPUT",
    "field_blur": "EDIT_INPUT",
    "paste_event": "EDIT_INPUT",
    "input_abandon": "ABANDON_INPUT",
    "rage_click": "RAGE_CLICK",
    "tab_exit": "TAB_OUT",
    "tab_return": "TAB_RETURN",
    "inactivity": "INACTIVE",
}

# Semantics by area, one table per family of events.
POINTED = {"REVIEW": "VIEW_REVIEW", "SHIPPING": "CHECK_SHIPPING", "SIZE": "CHECK_SIZE", "PRICE": "CHECK_PRICE"}
ENTERED = {**POINTED, "IMAGE": "VIEW_IMAGE", "PRODUCT_DETAIL": "VIEW_PRODUCT"}
DWELT = {**POINTED, "IMAGE": "VIEW_PRODUCT", "PRODUCT_DETAIL": "VIEW_PRODUCT"}
REVISITED = {"REVIEW": "VIEW_REVIEW", "IMAGE": "VIEW_PRODUCT", "PRODUCT_DETAIL": "VIEW_PRODUCT"}
SCROLLED = {"REVIEW": "SCROLL_REVIEW", "PRICE": "CHECK_PRICE", "SIZE": "CHECK_SIZE", "SHIPPING": "CHECK_SHIPPING"}
SCROLLED_PAGE = {"HOME": "SCROLL_HOME", "CATEGORY": "SCROLL_CATEGORY"}

# Semantics by click or hover text.
TEXT_SEMANTICS: Rules = [
    ("VIEW_REVIEW", ["리뷰", "후기", "review"]),
    ("CHECK_SHIPPING", ["배송", "delivery", "shipping"]),
    ("CHECK_SIZE", ["사이즈", "size"]),
    ("CHECK_PRICE", ["가격", "price", "할인", "쿠폰", "discount", "coupon"]),
    ("ADD_CART", ["장바구니", "cart", "bag", "basket", "담기"]),
    ("CLICK_BUY", ["구매", "결제", "buy", "checkout", "purchase"]),
]

# The only semantics that carry a context.
CONTEXT_SEMANTICS = [
    "VIEW_PRODUCT", "SCROLL_PRODUCT", "VIEW_REVIEW", "SCROLL_REVIEW", "CHECK_SHIPPING", "CHECK_SIZE", "CHECK_PRICE",
]

# On the home page these events or areas mean that a product is being looked at.
PRODUCT_EVENTS = [
    "product_click", "add_to_cart", "remove_from_cart", "purchase_click", "option_select", "option_change",
    "quantity_change", "review_click", "review_page_change", "review_image_click", "review_scroll",
    "review_area_scroll", "image_zoom", "image_slide", "video_play", "video_watch_pct", "cart_abandon_flag",
]
PRODUCT_AREAS = [name for name, _ in AREAS]


def dwell_bucket(ms: Column) -> Column:
    return (
        F.when(ms <= 5_000, "DWELL_SHORT").when((ms <= 20_000) | ms.isNull(), "DWELL_MEDIUM").otherwise("DWELL_LONG")
    )


def scroll_bucket(pct: Column) -> Column:
    return F.when(pct <= 30, "SCROLL_LOW").when((pct <= 70) | pct.isNull(), "SCROLL_MID").otherwise("SCROLL_HIGH")


def hover_bucket(ms: Column) -> Column:
    return F.when((ms <= 5_000) | ms.isNull(), "HOVER_SHORT").otherwise("HOVER_LONG")


def revisit_bucket(count: Column) -> Column:
    return F.when((count <= 1) | count.isNull(), "REVISIT_ONCE").otherwise("REVISIT_MULTI")


def make_token(page: Column, semantic: Column, context: Column) -> Column:
    """Null when the semantic is null; the context survives for seven semantics only."""
    kept = F.when(semantic.isin(CONTEXT_SEMANTICS), F.coalesce(context, F.lit("NONE"))).otherwise("NONE")
    return F.concat(page, F.lit("|"), semantic, F.lit("|"), kept)


def resolve_page(page: Column, event_type: Column, area: Column) -> Column:
    about_product = event_type.isin(PRODUCT_EVENTS) | area.isin(PRODUCT_AREAS)
    return F.when((page == "HOME") & about_product, F.lit("PRODUCT")).otherwise(page)


def semantic_from_text(text: Column) -> Column:
    return first_match(lowered(text), TEXT_SEMANTICS)


def semantic_in_text(lower: Column) -> Column:
    """The same in a long lower-case text."""
    return first_in_text(lower, lower, TEXT_SEMANTICS)


def token_parts(token: Column) -> tuple[Column, Column, Column]:
    """Page, semantic and context; UNKNOWN for a token that has not three parts."""
    parts = F.split(token, r"\|")
    whole = F.size(parts) == 3
    return tuple(F.when(whole, parts[i]).otherwise(F.lit("UNKNOWN")) for i in range(3))


def _first(p: Column, names: list[str], falsy: bool) -> Column:
    """First present payload value; with ``falsy`` a 0 counts as absent, as the collector's own tools do."""
    values = [F.nullif(p[n], F.lit(0.0)) if falsy else p[n] for n in names]
    return F.coalesce(*values)


def _text(p: Column, names: list[str]) -> Column:
    return F.coalesce(*(blank_to_null(p[n]) for n in names))


def _emits(kind: Column, area: Column, unknown: bool) -> Column:
    """Whether an event leaves a token. Asked instead of "is the token null", which Spark would evaluate early."""
    by_area = (kind.isin(ENTER_EVENTS) & area.isin(list(ENTERED))) | (kind.isin(REVISIT_EVENTS) & area.isin(list(REVISITED)))
    out = kind.isin([*FAMILY_EVENTS, *EVENT_SEMANTICS]) | by_area
    return out | ~kind.isin(CONTEXT_ONLY_EVENTS) if unknown else out


def with_token(df: DataFrame, payload: str = "p", compat: bool = False, unknown: bool = False) -> DataFrame:
    """Rows that leave a token, with ``token`` added; ``unknown`` keeps unmapped events as tokens too.

    Needs event_type, the payload, the carried page, section and subsection, and ``own_page``.

    What several families share (areas, text meanings, the page) becomes a column first, so that the
    generated code evaluates it once per row.
    """
    p, kind = F.col(payload), F.col("event_type")
    section, subsection = F.col("section"), F.col("subsection")
    dwelt_in = F.coalesce(_text(p, ["subsection_id", "subsection"]), subsection)
    # the event's own section is the more direct signal, in this order
    own_rules = [rule for name in ("PRICE", "REVIEW", "SHIPPING", "SIZE") for rule in AREAS if rule[0] == name]
    names = {
        "__place": F.coalesce(blank_to_null(lowered(subsection)), lowered(section)),
        "__dwelt": F.coalesce(blank_to_null(lowered(dwelt_in)), lowered(section)),
        "__own": lowered(_text(p, ["section", "element_section"])),
        "__hover": lowered(_text(p, ["hover_text", "hover_target"])),
        "__click": lowered(_text(p, ["click_text", "click_target"])),
    }
    # asked only of the events that use them, and only where there is a text
    asked = {
        "__dwell_area": ("__dwelt", AREAS, ["subsection_dwell"]),
        "__own_area": ("__own", own_rules, ["hover", "click"]),
        "__hover_sem": ("__hover", TEXT_SEMANTICS, ["hover", "hover_dwell"]),
        "__click_sem": ("__click", TEXT_SEMANTICS, ["click"]),
    }
    out = df.withColumns(names).withColumns(
        {
            "__area": F.when(F.col("__place") == "", F.lit("UNKNOWN_AREA")).otherwise(first_match("__place", AREAS, "UNKNOWN_AREA")),
            **{name: F.when(kind.isin(kinds) & (F.col(text) != ""), first_match(text, rules)) for name, (text, rules, kinds) in asked.items()},
        }
    )
    area = F.col("__area")
    out = out.where(_emits(kind, area, unknown)).withColumns(
        {
            "__at": resolve_page(F.coalesce(F.col("page"), F.col("own_page")), kind, area),
            "__pointed": F.coalesce(lookup("__own_area", POINTED), lookup("__area", POINTED)),
        }
    )
    out = out.withColumn("__sem", _semantic(p, kind))
    context = _context(p, kind, compat)
    page = F.when(kind == "navigation", F.col("own_page")).otherwise(F.col("__at"))
    temporary = [*names, "__area", "__dwell_area", "__own_area", "__hover_sem", "__click_sem", "__at", "__pointed", "__sem"]
    token = make_token(page, F.col("__sem"), context)
    if unknown:
        raw = F.concat_ws("|", F.coalesce(F.col("page"), F.lit("UNKNOWN")), F.lit("UNKNOWN_EVENT"), kind)
        token = F.coalesce(token, raw)
    return out.withColumn("token", token).drop(*temporary)


def _semantic(p: Column, kind: Column) -> Column:
    """Semantic of the event's family, null where it leaves no token."""
    area, at = F.col("__area"), F.col("__at")
    scrolled = F.coalesce(
        lookup("__area", SCROLLED),
        F.when((at == "PRODUCT") | area.isin("PRODUCT_DETAIL", "IMAGE"), F.lit("SCROLL_PRODUCT")),
        lookup("__at", SCROLLED_PAGE),
        F.lit("SCROLL_PAGE"),
    )
    hover, click, pointed = F.col("__hover_sem"), F.col("__click_sem"), F.col("__pointed")
    hovered_long = F.when((hover == "CHECK_SIZE") | (area == "SIZE"), F.lit("CHECK_SIZE")).otherwise(
        F.coalesce(hover, lookup("__area", POINTED), F.lit("HOVER_ELEMENT"))
    )
    left = F.when(F.coalesce(p["bounce_flag"], F.lit(False)), F.lit("EXIT_BOUNCE")).otherwise("EXIT_SESSION")
    return (
        F.when(kind == "navigation", F.concat(F.lit("ENTER_"), F.col("own_page")))
        .when(kind == "session_end", left)
        .when(kind.isin("scroll_depth", "scroll_milestone"), scrolled)
        .when(kind == "subsection_dwell", F.coalesce(lookup("__dwell_area", DWELT), F.lit("VIEW_SECTION")))
        .when(kind.isin(ENTER_EVENTS), lookup("__area", ENTERED))
        .when(kind.isin(REVISIT_EVENTS), lookup("__area", REVISITED))
        .when(kind == "hover_dwell", hovered_long)
        .when(kind == "hover", F.coalesce(hover, pointed, F.lit("HOVER_ELEMENT")))
        .when(kind == "click", F.coalesce(click, pointed, F.lit("CLICK_ELEMENT")))
        .otherwise(lookup(kind, EVENT_SEMANTICS))
    )


def _context(p: Column, kind: Column, compat: bool) -> Column:
    """Bucket that goes with the event's family, null for none."""
    sem = F.col("__sem")
    depth = _first(p, ["depth_pct", "milestone", "scroll_depth_pct", "max_scroll_depth"], compat)
    review_depth = _first(p, ["depth_pct", "scroll_depth_pct"], compat)
    dwell = _first(p, ["dwell_ms", "dwell_time_ms"], compat)
    hover = p["hover_dwell_time_ms"]
    revisits = p["revisit_count"] if compat else F.coalesce(p["revisit_count"], p["count"])
    return (
        F.when(kind.isin("review_scroll", "review_area_scroll"), scroll_bucket(review_depth))
        .when(kind.isin("scroll_depth", "scroll_milestone") & (sem != "CHECK_SHIPPING"), scroll_bucket(depth))
        .when(kind == "subsection_dwell", dwell_bucket(dwell))
        .when(kind.isin(REVISIT_EVENTS), revisit_bucket(revisits))
        .when((kind == "hover_dwell") & (sem == "CHECK_SIZE"), hover_bucket(hover))
        .when(kind == "hover_dwell", dwell_bucket(hover))
    )


# Fixed values: (event_type, action) of an external clickstream to a token.
EXTERNAL_TOKENS = {
    "event_product/detail": "PRODUCT|VIEW_PRODUCT|NONE",
    "event_product/add": "PRODUCT|ADD_CART|NONE",
    "event_product/remove": "CART|REMOVE_CART|NONE",
    "event_product/purchase": "CHECKOUT|PURCHASE|NONE",
}
EXTERNAL_TOKENS_BY_URL = {
    **EXTERNAL_TOKENS,
    "event_product/purchase": "CHECKOUT|CLICK_BUY|NONE",
    "event_product/click": "CATEGORY|VIEW_PRODUCT|NONE",
    "event_product/promo_click": "HOME|VIEW_PRODUCT|NONE",
}


def external_token(event_type: Column, action: Column, first: Column, page: Column | None = None) -> Column:
    """Token of an external event; page views are told apart by URL when there is one."""
    key = F.concat(event_type, F.lit("/"), F.coalesce(action, F.lit("")))
    view = event_type == "pageview"
    home = F.when(first, F.lit("HOME|ENTER_HOME|NONE")).otherwise("HOME|SCROLL_HOME|NONE")
    if page is None:
        return F.coalesce(lookup(key, EXTERNAL_TOKENS), F.when(view, home))
    listing = F.when(first, F.lit("CATEGORY|ENTER_CATEGORY|NONE")).otherwise("CATEGORY|SCROLL_CATEGORY|NONE")
    viewed = (
        F.when(page == "PRODUCT", F.lit("PRODUCT|VIEW_PRODUCT|NONE"))
        .when(page == "CATEGORY", listing)
        .when(page == "CART", F.lit("CART|ENTER_CART|NONE"))
        .when(page == "CHECKOUT", F.lit("CHECKOUT|ENTER_CHECKOUT|NONE"))
        .otherwise(home)
    )
    return F.coalesce(lookup(key, EXTERNAL_TOKENS_BY_URL), F.when(view, viewed))


# The action names a classifier of live sessions accepts.
LIVE_ACTIONS = {
    "enter_category": "ENTER_CATEGORY",
    "enter_product": "ENTER_PRODUCT",
    "purchase_click": "CLICK_BUY",
    "add_to_cart": "ADD_CART",
    "tab_exit": "TAB_OUT",
    "tab_return": "TAB_RETURN",
    "inactivity": "INACTIVE",
    "search_use": "SEARCH_USE",
    "hover_dwell": "HOVER_ELEMENT",
    "section_exit": "EXIT_SESSION",
    "session_start": "START_SESSION",
}
LIVE_SUBSECTIONS = {
    "review": "VIEW_REVIEW",
    "qa": "VIEW_QNA", "qna": "VIEW_QNA", "inquiry": "VIEW_QNA",
    "detail": "VIEW_DETAIL", "product_detail": "VIEW_DETAIL",
}


def order_succeeded(payload: Column) -> Column:
    """The page said that the order was placed."""
    said = F.concat_ws(" ", payload["hover_text"], payload["click_text"])
    target = F.lower(F.concat_ws(" ", payload["hover_target"], payload["click_target"]))
    return said.contains("주문이 완료") | target.contains("complete")


def normalize_event_type(event_type: Column, payload: Column, page: Column) -> Column:
    """Raw event to action name, given its simple page; unknown types stay as they are."""
    scrolls = event_type.isin("scroll_depth", "scroll_speed", "scroll_stop", "scroll_milestone")
    own = lookup(F.lower(F.coalesce(payload["subsection_id"], F.lit(""))), LIVE_SUBSECTIONS)
    return (
        F.when(event_type.isin("enter_category", "enter_product"), lookup(event_type, LIVE_ACTIONS))
        .when(event_type == "subsection_enter", F.coalesce(own, F.lit("CLICK_ELEMENT")))
        .when(order_succeeded(payload), F.lit("CLICK_BUY"))
        .when((event_type == "product_click") & (page == "product"), F.lit("ENTER_PRODUCT"))
        .when((event_type == "click") & (page == "checkout"), F.lit("CLICK_BUY"))
        .when(event_type.isin("product_click", "click"), F.lit("CLICK_ELEMENT"))
        .when(scrolls & (page == "product"), F.lit("SCROLL_PRODUCT"))
        .when(scrolls & (page == "home"), F.lit("SCROLL_HOME"))
        .otherwise(F.coalesce(lookup(event_type, LIVE_ACTIONS), event_type))
    )


# The classifier's own names; any other action counts as a click on an element.
LIVE_PAGES = {"home": "HOME", "product": "PRODUCT", "cart": "CART", "checkout": "CHECKOUT", "search": "SEARCH"}
LIVE_SEMANTICS = [
    "ENTER_HOME", "ENTER_PRODUCT", "ENTER_CART", "ENTER_CHECKOUT", "SCROLL_PRODUCT", "SCROLL_PRODUCT_DETAIL",
    "SCROLL_REVIEW", "SCROLL_HOME", "ZOOM_IMAGE", "ADD_CART", "REMOVE_CART", "CLICK_BUY", "VIEW_REVIEW",
    "CHECK_PRICE", "CHECK_SHIPPING", "CHECK_SIZE", "SEARCH_USE", "HOVER_ELEMENT", "CLICK_ELEMENT",
    "START_SESSION", "TAB_OUT", "TAB_RETURN", "INACTIVE", "EXIT_SESSION", "EXIT_BOUNCE", "RAGE_CLICK",
]


def live_token(action: Column, page: Column) -> Column:
    semantic = F.when(action.isin(LIVE_SEMANTICS), action).otherwise(F.lit("CLICK_ELEMENT"))
    return F.concat(F.coalesce(lookup(page, LIVE_PAGES), F.lit("UNKNOWN")), F.lit("|"), semantic, F.lit("|NONE"))
