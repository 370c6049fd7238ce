"""Cluster profiles: what a cluster does, what it is called, how far it can be trusted.

A profile row has cluster, count, ``top_actions`` (array of action and count, at most 10) and
``page_dist`` (array of page and count, at most 6).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.rules import lookup
from pathloom.functions.tokens import token_parts
from pathloom.operators.reports import HIGH, LOW, MEDIUM
from pathloom.operators.sequences import top_k
from pathloom.operators.sessions import SESSION

# Actions that say nothing about a customer.
GENERIC_ACTIONS = [
    "HOVER_ELEMENT", "CLICK_ELEMENT", "SCROLL_PAGE", "SCROLL_HOME", "SCROLL_PRODUCT", "SCROLL", "NAVIGATE",
    "START_SESSION", "ENTER_HOME", "ENTER_PRODUCT", "START_INPUT", "TAB_RETURN",
]

# Display names of actions and pages.
ACTION_NAMES = {
    "START_SESSION": "방문 시작",
    "TAB_OUT": "다른 창으로 탐색 중지",
    "CHECK_PRICE": "가격 확인",
    "ADD_CART": "장바구니 담기",
    "CLICK_BUY": "구매하기 클릭",
    "VIEW_PRODUCT": "상품 상세 확인",
    "VIEW_IMAGE": "이미지 크게 보기",
    "VIEW_OPTION": "옵션 확인",
    "VIEW_REVIEW": "구매 후기 확인",
    "SCROLL": "페이지 스크롤",
    "CLICK": "항목 클릭",
    "VIEW": "상품 조회",
    "LIKE": "찜하기",
    "SEARCH": "검색",
    "FILTER": "필터 적용",
    "BACK": "이전으로 이동",
    "INACTIVE": "장시간 머묾(비활성)",
    "NAVIGATE": "페이지 이동",
    "CART_VIEW": "장바구니 확인",
    "SCROLL_HOME": "홈 화면 둘러보기",
    "SCROLL_PRODUCT": "상품 페이지 둘러보기",
    "SCROLL_PRODUCT_DETAIL": "상품 상세 정독",
    "SCROLL_REVIEW": "후기 꼼꼼히 읽기",
    "SCROLL_PRICE": "가격 훑어보기",
    "SCROLL_SIZE": "사이즈 정보 확인",
    "SCROLL_PAGE": "페이지 스크롤",
    "HOVER_ELEMENT": "항목에 마우스 올림",
    "CLICK_ELEMENT": "항목 클릭",
    "ZOOM_IMAGE": "이미지 확대",
    "WATCH_VIDEO": "상품 영상 시청",
    "ENTER_HOME": "홈 화면 진입",
    "ENTER_PRODUCT": "상품 페이지 진입",
    "ENTER_CART": "장바구니 진입",
    "ENTER_CATEGORY": "카테고리 진입",
    "CHECK_SIZE": "사이즈 확인",
    "CHECK_SHIPPING": "배송 정보 확인",
    "CHANGE_OPTION": "옵션 변경",
    "CHANGE_QUANTITY": "수량 변경",
    "REMOVE_CART": "장바구니에서 제거",
    "SEARCH_USE": "검색 사용",
    "START_INPUT": "입력 시작",
    "TAB_RETURN": "다시 돌아옴",
    "RAGE_CLICK": "반복 클릭(짜증 신호)",
    "DISTRACTED_EPISODE": "주의 분산",
    "EXIT_SESSION": "방문 종료",
    "EXIT_BOUNCE": "즉시 탐색 중지",
}
PAGE_NAMES = {
    "HOME": "홈 화면", "PRODUCT": "상품 상세", "CART": "장바구니", "CHECKOUT": "결제 페이지", "SEARCH": "검색 결과",
    "CATEGORY": "카테고리", "WISHLIST": "찜 목록", "MYPAGE": "마이페이지",
}
# The term that reports avoid and its replacement.
AVOIDED_TERM, REPLACEMENT_TERM = "이탈", "탐색 중지"


def display_action(action: Column) -> Column:
    return F.coalesce(lookup(action, ACTION_NAMES), F.initcap(F.lower(F.replace(action, F.lit("_"), F.lit(" ")))))


def display_page(page: Column) -> Column:
    return F.coalesce(lookup(page, PAGE_NAMES), page)


def report_text(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(AVOIDED_TERM), F.lit(REPLACEMENT_TERM))


# --- building ----------------------------------------------------------------------------------------


def profile_counts(long: DataFrame, assignments: DataFrame, keys: Sequence[str] = SESSION, noise: bool = False) -> DataFrame:
    """Tokens per cluster: (cluster, token, n). Counted per session first, so few rows meet the labels."""
    per_session = long.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    labels = assignments if noise else assignments.where(F.col("cluster") >= 0)
    return per_session.join(labels.select(*keys, "cluster"), on=list(keys)).groupBy("cluster", "token").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, value: Column, k: int, name: str, field: str) -> DataFrame:
    """The ``k`` most frequent values per cluster as one short array."""
    summed = counts.select("cluster", value.alias("__v"), "n").groupBy("cluster", "__v").agg(F.sum("n").alias("n"))
    best = top_k(summed, ["cluster"], "n", "__v", k)
    item = F.struct("rank", F.col("__v").alias(field), F.col("n").alias("count"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x[field].alias(field), x["count"].alias("count")))
    return best.groupBy("cluster").agg(listed.alias(name))


def cluster_profiles(
    long: DataFrame, assignments: DataFrame, keys: Sequence[str] = SESSION, actions: int = 10, pages: int = 6, noise: bool = False
) -> DataFrame:
    from pathloom.session import cut

    labels = assignments if noise else assignments.where(F.col("cluster") >= 0)
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    counts = cut(profile_counts(long, assignments, keys, noise))
    page, semantic, _ = token_parts(F.col("token"))
    out = sizes.join(_top(counts, semantic, actions, "top_actions", "action"), on="cluster", how="left")
    return out.join(_top(counts, page, pages, "page_dist", "page"), on="cluster", how="left")


def cluster_summary(
    long: DataFrame, assignments: DataFrame, keys: Sequence[str] = SESSION, k: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and lengths; top tokens, actions and pages (cluster, kind, rank, value, n); sample sessions. With noise."""
    from pathloom.session import cut

    lengths = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("length")).join(assignments.select(*keys, "cluster"), on=list(keys))
    sizes = lengths.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg("length"), 2).alias("avg_length"),
        F.min("length").alias("min_length"), F.max("length").alias("max_length"),
    )
    counts = cut(profile_counts(long, assignments, keys, noise=True))
    page, semantic, _ = token_parts(F.col("token"))
    tops = None
    for kind, value in (("token", F.col("token")), ("action", semantic), ("page", page)):
        summed = counts.select("cluster", value.alias("value"), "n").groupBy("cluster", "value").agg(F.sum("n").alias("n"))
        part = top_k(summed, ["cluster"], "n", "value", k).withColumn("kind", F.lit(kind))
        tops = part if tops is None else tops.unionByName(part)
    w = Window.partitionBy("cluster").orderBy("session_id")
    samples = lengths.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return sizes, tops, samples


# --- naming ------------------------------------------------------------------------------------------


def _count_of(pairs: str, field: str, *names: str) -> Column:
    kept = F.filter(F.coalesce(F.col(pairs), F.array()), lambda x: x[field].isin(*names))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x["count"])


def _sum_of(pairs: str) -> Column:
    return F.aggregate(F.coalesce(F.col(pairs), F.array()), F.lit(0).cast("long"), lambda s, x: s + x["count"])


# Customer types in the order in which they are tried.
TYPES = {
    "buyer": "구매 결정형",
    "price": "가격 비교형",
    "leaver": "탐색 중지 위험형",
    "careful": "신중 탐색형",
    "visual": "비주얼 탐색형",
    "product": "상품 집중형",
    "home": "홈 체류형",
    "general": "일반 탐색형",
}


def type_name() -> Column:
    """Customer type by the shares of actions and pages in a profile row."""
    actions = F.greatest(_sum_of("top_actions"), F.lit(1))
    pages = F.greatest(_sum_of("page_dist"), F.lit(1))

    def share(*names: str) -> Column:
        return _count_of("top_actions", "action", *names) / actions

    def page_share(name: str) -> Column:
        return _count_of("page_dist", "page", name) / pages

    tests = {
        "buyer": (share("ADD_CART", "CLICK_BUY") > 0.15) | (share("ADD_CART") > 0.1),
        "price": share("SCROLL_PRICE", "CHECK_PRICE") > 0.2,
        "leaver": share("TAB_OUT", "EXIT_BOUNCE") > 0.25,
        "careful": share("VIEW_REVIEW") > 0.08,
        "visual": share("VIEW_IMAGE") > 0.1,
        "product": page_share("PRODUCT") > 0.7,
        "home": page_share("HOME") > 0.5,
    }
    out = None
    for name, test in tests.items():
        out = F.when(test, F.lit(TYPES[name])) if out is None else out.when(test, F.lit(TYPES[name]))
    return out.otherwise(F.lit(TYPES["general"]))


def infer_intent() -> Column:
    """Will to buy from a profile row alone, by shares of the actions that are not generic."""
    telling = F.filter(F.coalesce(F.col("top_actions"), F.array()), lambda x: ~x["action"].isin(GENERIC_ACTIONS))
    total = F.greatest(F.aggregate(telling, F.lit(0).cast("long"), lambda s, x: s + x["count"]), F.lit(1))
    buy = _count_of("top_actions", "action", "ADD_CART", "CLICK_BUY") / total
    leave = _count_of("top_actions", "action", "TAB_OUT", "EXIT_BOUNCE", "INACTIVE") / total
    return F.when(buy > 0.08, F.lit(HIGH)).when(leave > 0.25, F.lit(LOW)).otherwise(F.lit(MEDIUM))


def significant_actions(n: int = 7) -> Column:
    """Telling actions of a profile row, filled up with generic ones when fewer than ``n``."""
    acts = F.coalesce(F.col("top_actions"), F.array())
    telling = F.filter(acts, lambda x: ~x["action"].isin(GENERIC_ACTIONS))
    return F.slice(F.concat(telling, F.filter(acts, lambda x: x["action"].isin(GENERIC_ACTIONS))), 1, n)


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of the same customer type as one, numbered by size: (rank, name, count, members, …)."""
    typed = profiles.withColumn("name", type_name())
    heads = typed.groupBy("name").agg(F.sum("count").alias("count"), F.array_sort(F.collect_list("cluster")).alias("members"))

    def summed(pairs: str, field: str) -> DataFrame:
        items = typed.select("name", F.explode(pairs).alias("x")).groupBy("name", f"x.{field}").agg(F.sum("x.count").alias("n"))
        order = F.struct((-F.col("n")).alias("m"), F.col(field), F.col("n").alias("count"))
        listed = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x[field].alias(field), x["count"].alias("count")))
        return items.groupBy("name").agg(listed.alias(pairs))

    out = heads.join(summed("top_actions", "action"), on="name", how="left").join(summed("page_dist", "page"), on="name", how="left")
    w = Window.partitionBy().orderBy(F.desc("count"), "name")  # one row per type, eight at most
    return out.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


# Names by a profile's three leading actions, tried in order.
LEADING_NAMES = [
    ("결제 단계에서 망설이는 고객", ["ENTER_CHECKOUT", "START_INPUT", "EDIT_INPUT"]),
    ("탐색을 빠르게 멈추는 고객", ["EXIT_BOUNCE", "EXIT_SESSION", "INACTIVE"]),
    ("상품을 찾고 비교하는 고객", ["ENTER_CATEGORY", "SEARCH_USE"]),
    ("구매 조건을 확인하는 고객", ["CHECK_PRICE", "CHECK_SIZE", "CHECK_SHIPPING"]),
    ("후기와 이미지를 확인하는 고객", ["VIEW_REVIEW", "VIEW_QNA", "VIEW_DETAIL", "ZOOM_IMAGE"]),
    ("페이지를 훑어보는 고객", ["SCROLL_HOME", "SCROLL_PRODUCT"]),
]
UNKNOWN_CUSTOMER = "행동 데이터 부족 고객"

# What tells clusters of the same name apart, by actions and then by pages.
QUALIFIERS = [
    ("결제 진입형", ["ENTER_CHECKOUT"]),
    ("입력 진행형", ["START_INPUT", "EDIT_INPUT"]),
    ("가격 확인형", ["CHECK_PRICE"]),
    ("빠른 중지형", ["EXIT_BOUNCE", "EXIT_SESSION"]),
    ("카테고리 탐색형", ["SEARCH_USE", "ENTER_CATEGORY"]),
    ("상품 페이지형", ["SCROLL_PRODUCT"]),
    ("홈 화면형", ["SCROLL_HOME"]),
    ("후기 확인형", ["VIEW_REVIEW", "ZOOM_IMAGE"]),
]
PAGE_QUALIFIERS = [
    ("결제 화면형", ["CHECKOUT"]),
    ("상품 화면형", ["PRODUCT"]),
    ("카테고리형", ["CATEGORY"]),
    ("홈 화면형", ["HOME"]),
]
NO_QUALIFIER = "행동 패턴형"


def _names(pairs: str, field: str) -> Column:
    return F.transform(F.coalesce(F.col(pairs), F.array()), lambda x: x[field])


def _first_overlap(subject: Column, table: Sequence[tuple[str, list[str]]]) -> Column:
    """Name of the first entry that shares a value with ``subject``, else null."""
    return F.coalesce(
        *(F.when(F.arrays_overlap(subject, F.array(*map(F.lit, names))), F.lit(name)) for name, names in table)
    )


def rule_label() -> Column:
    """Name of a cluster by its three leading actions."""
    actions = _names("top_actions", "action")
    return F.coalesce(_first_overlap(F.slice(actions, 1, 3), LEADING_NAMES), F.lit(UNKNOWN_CUSTOMER))


def cluster_qualifier() -> Column:
    return F.coalesce(
        _first_overlap(_names("top_actions", "action"), QUALIFIERS),
        _first_overlap(_names("page_dist", "page"), PAGE_QUALIFIERS),
        F.lit(NO_QUALIFIER),
    )


def unique_labels(profiles: DataFrame) -> DataFrame:
    """Add ``label``, told apart by a qualifier and a running number where several clusters share one."""
    rows = profiles.withColumns({"__base": rule_label(), "__qualifier": cluster_qualifier()})
    shared = F.count(F.lit(1)).over(Window.partitionBy("__base")) > 1
    candidate = F.concat_ws(" · ", "__base", "__qualifier")
    nth = F.row_number().over(Window.partitionBy("__base", "__qualifier").orderBy("cluster"))
    numbered = F.when(nth == 1, candidate).otherwise(F.concat_ws(" ", candidate, nth.cast("string")))
    return rows.withColumn("label", F.when(shared, numbered).otherwise(F.col("__base"))).drop("__base", "__qualifier")


def profile_label() -> Column:
    """Short technical name: cluster, two leading actions, main page."""
    top = F.slice(_names("top_actions", "action"), 1, 2)
    page = F.coalesce(F.try_element_at(_names("page_dist", "page"), F.lit(1)), F.lit("?"))
    named = F.concat(F.lit("C"), F.col("cluster").cast("string"), F.lit(":"), F.array_join(top, "+"), F.lit("/"), page)
    return F.when(F.size(top) > 0, named).otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))


# Names of actions on the operator's screen; other actions are shown in lower case.
SCREEN_ACTIONS = {
    "SCROLL_HOME": "홈 화면 스크롤",
    "SCROLL_PRODUCT": "상품 페이지 스크롤",
    "SCROLL_PAGE": "페이지 스크롤",
    "ENTER_CATEGORY": "카테고리 진입",
    "ENTER_PRODUCT": "상품 상세 진입",
    "ENTER_CHECKOUT": "결제 화면 진입",
    "VIEW_PRODUCT": "상품 확인",
    "VIEW_DETAIL": "상세정보 확인",
    "VIEW_REVIEW": "리뷰 확인",
    "VIEW_QNA": "상품 문의 확인",
    "ZOOM_IMAGE": "상품 이미지 확대",
    "HOVER_ELEMENT": "요소 위에 머무름",
    "CLICK_ELEMENT": "버튼 또는 메뉴 클릭",
    "SEARCH_USE": "검색 사용",
    "CHECK_PRICE": "가격 확인",
    "CHECK_SIZE": "사이즈 확인",
    "CHECK_SHIPPING": "배송 정보 확인",
    "START_INPUT": "입력 시작",
    "EDIT_INPUT": "입력 수정",
    "EXIT_BOUNCE": "빠른 탐색 중지",
    "EXIT_SESSION": "탐색 중지",
    "INACTIVE": "움직임 없음",
    "RAGE_CLICK": "반복 클릭",
    "CHANGE_QUANTITY": "수량 변경",
}
# Texts of a cluster with and without data.
SUMMARY_END = " 중심으로 묶인 고객 유형입니다."
SUMMARY_NO_ACTION = "행동 패턴"
NO_DATA_SUMMARY = "세션은 확인됐지만 대표 행동이나 방문 화면 정보가 부족해 패턴을 명확히 해석하기 어렵습니다."
ADVICE = "이 유형의 주요 행동이 많은 화면을 점검하고, 다음 행동으로 이어지는 안내 문구를 보강하세요."
NO_DATA_ADVICE = "SDK 수집 상태와 페이지별 이벤트 매핑을 먼저 점검해 행동 데이터가 충분히 쌓이도록 보완하세요."


def screen_action(action: Column) -> Column:
    return F.coalesce(lookup(action, SCREEN_ACTIONS), F.lower(F.replace(action, F.lit("_"), F.lit(" "))))


def has_data() -> Column:
    """Whether a profile row knows any action or page."""
    return (F.size(_names("top_actions", "action")) > 0) | (F.size(_names("page_dist", "page")) > 0)


def summary_text() -> Column:
    """One sentence about a profile row: its three leading actions, or that there is too little data."""
    leading = F.transform(F.slice(_names("top_actions", "action"), 1, 3), lambda a: screen_action(a))
    listed = F.coalesce(F.nullif(F.array_join(leading, ", "), F.lit("")), F.lit(SUMMARY_NO_ACTION))
    return F.when(has_data(), F.concat(listed, F.lit(SUMMARY_END))).otherwise(F.lit(NO_DATA_SUMMARY))


def advice_text() -> Column:
    return F.when(has_data(), F.lit(ADVICE)).otherwise(F.lit(NO_DATA_ADVICE))


def insight_text(profiles: DataFrame, templates: DataFrame, name: str = "name") -> DataFrame:
    """Fill the caller's texts per type: ``{share}`` and ``{actions}`` are replaced."""
    share = F.bround(F.col("count") * 100 / F.sum("count").over(Window.partitionBy())).cast("long").cast("string")
    top = F.transform(significant_actions(3), lambda x: display_action(x["action"]))
    rows = profiles.withColumns({"__share": share, "__top": F.array_join(top, ", ")})
    out = rows.join(templates.select(F.col("name").alias(name), "template"), on=name, how="left")
    filled = F.replace(F.replace(F.col("template"), F.lit("{share}"), F.col("__share")), F.lit("{actions}"), F.col("__top"))
    return out.withColumn("insight", report_text(filled)).drop("__share", "__top", "template")


# --- trust -------------------------------------------------------------------------------------------

# Verdicts and reasons.
VERDICTS = {"verified": "검증 통과", "weak": "검증 필요", "insufficient": "데이터 부족"}
REASONS = {
    "evidence": "대표 행동 또는 방문 화면 근거가 부족합니다.",
    "few": "세션 수가 적어 안정성이 낮을 수 있습니다.",
    "share": "전체 세션에서 차지하는 비중이 작습니다.",
    "unstable": "이전 실행과 행동 구성이 크게 달라졌습니다.",
}


def cluster_validation(profiles: DataFrame, total: Column, compat: bool = False) -> DataFrame:
    """Add status, its label, reasons and the share in percent. Needs count and, optionally, ``stability``.

    ``compat`` keeps the label "passed" for clusters that are weak only by share or stability.
    """
    has_actions = F.coalesce(F.size("top_actions") > 0, F.lit(False))
    has_pages = F.coalesce(F.size("page_dist") > 0, F.lit(False))
    share = F.when(total > 0, F.col("count") / total).otherwise(0.0)
    stability = F.col("stability") if "stability" in profiles.columns else F.lit(None).cast("double")
    bare, few = ~(has_actions & has_pages), F.col("count") < 5
    small = (share > 0) & (share < 0.05)
    unstable = F.coalesce(stability < 0.35, F.lit(False))
    status = F.when(bare, "insufficient").when(few | small | unstable, "weak").otherwise("verified")
    shown = F.when(bare, "insufficient").when(few, "weak").otherwise("verified") if compat else status
    reasons = F.array_compact(
        F.array(*(F.when(t, F.lit(REASONS[n])) for n, t in (("evidence", bare), ("few", few), ("share", small), ("unstable", unstable))))
    )
    return profiles.withColumns(
        {
            "status": status,
            "status_label": lookup(shown, VERDICTS),
            "reasons": reasons,
            "session_share": F.round(share * 100, 1),
            "has_top_actions": has_actions,
            "has_page_distribution": has_pages,
        }
    )


#: What a run knows about itself and a summary passes on, as it is.
MEASURES = {"clustered_session_count": "long", "silhouette": "double", "davies_bouldin": "double", "stability": "double", "note": "string"}


def quality_summary(
    validated: DataFrame, noise_count: Column, sample_count: Column | None = None, measures: dict[str, Column] | None = None
) -> DataFrame:
    """How many clusters hold up, with the sample size put right when the noise exceeds it.

    ``measures`` of the run (``MEASURES``) are passed on; what is not given is null, the note empty. A ``noise_rate`` among
    them takes the place of the computed one.
    """
    given = measures or {}
    n = F.sum("count")
    raw = sample_count if sample_count is not None else n
    sample = F.when(noise_count > raw, n + noise_count).otherwise(raw)
    out = validated.agg(
        sample.alias("sample_count"),
        noise_count.alias("noise_count"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_clusters") for s in VERDICTS),
        F.count(F.lit(1)).alias("visible_clusters"),
    )
    rate = F.round(F.try_divide("noise_count", "sample_count"), 4)
    if "noise_rate" in given:
        rate = F.coalesce(given["noise_rate"], rate)
    passed = {n: given.get(n, F.lit(None)).cast(t) for n, t in MEASURES.items()}
    return out.withColumns({"noise_rate": rate, **passed, "note": F.coalesce(passed["note"], F.lit(""))})


def profile_stability(new: DataFrame, old: DataFrame) -> DataFrame:
    """Best Jaccard similarity of each new profile with any old one: (cluster, stability).

    Compared through shared terms (five leading actions, five pages), so profiles that share nothing
    never meet. Null where a side has no terms.
    """

    def terms(profiles: DataFrame, side: str) -> DataFrame:
        acts = F.transform(F.slice(_names("top_actions", "action"), 1, 5), lambda a: F.concat(F.lit("A:"), a))
        pages = F.transform(F.slice(_names("page_dist", "page"), 1, 5), lambda p: F.concat(F.lit("P:"), p))
        both = F.array_distinct(F.concat(acts, pages))
        return profiles.select(F.col("cluster").alias(side), both.alias("t"), F.size(both).alias(f"{side}_size"))

    mine, theirs = terms(new, "cluster"), terms(old, "other").where("other_size > 0")
    shared = (
        mine.select("cluster", "cluster_size", F.explode("t").alias("term"))
        .join(theirs.select("other", "other_size", F.explode("t").alias("term")), on="term")
        .groupBy("cluster", "cluster_size", "other", "other_size").agg(F.count(F.lit(1)).alias("both"))
    )
    score = F.col("both") / (F.col("cluster_size") + F.col("other_size") - F.col("both"))
    best = shared.groupBy("cluster").agg(F.max(score).alias("best"))
    known = old.agg((F.count(F.lit(1)) > 0).alias("k")).select("k").scalar()
    rows = mine.select("cluster", "cluster_size").join(best, on="cluster", how="left").withColumn("__known", known)
    value = F.when(F.col("__known") & (F.col("cluster_size") > 0), F.coalesce("best", F.lit(0.0)))
    return rows.select("cluster", value.alias("stability"))


def mean_stability(stability: DataFrame) -> DataFrame:
    return stability.agg(F.round(F.avg("stability"), 4).alias("avg_profile_stability"))


def assemble(profiles: DataFrame, total: Column) -> DataFrame:
    """Cluster rows as shown to an operator: profile, unique label, summary and validation."""
    return cluster_validation(unique_labels(profiles).withColumn("summary", summary_text()), total)


def site_clusters(assigned: DataFrame, profiles: DataFrame, total: Column) -> tuple[DataFrame, DataFrame]:
    """Classified sessions of a site per cluster with profile and verdict, and the number left as noise."""
    counts = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    named = unique_labels(
        counts.where("cluster >= 0").join(profiles.drop("count"), on="cluster", how="left")
    )
    noise = counts.where("cluster < 0").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("noise_count"))
    return cluster_validation(named, total), noise


def live_distribution(
    long: DataFrame, sessions: DataFrame, vocab: DataFrame, table: DataFrame, keys: Sequence[str] = SESSION, newest: int | None = None
) -> DataFrame:
    """Where a site's sessions belong now: (cluster, count, total, share).

    ``sessions``: keys and last_at of the site; all of them or the ``newest``. Their tokens (``long``) are classified by the
    token centroids; ``total`` counts the sessions that were classified, whatever was asked for.
    """
    from pathloom.operators.clusters import classify_sessions

    if newest is not None:
        sessions = sessions.orderBy(F.desc("last_at"), *keys).limit(newest)
    own = long.join(sessions.select(*keys), on=list(keys), how="left_semi")
    counts = classify_sessions(own, vocab, table, keys).groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t")).scalar()
    return counts.withColumn("total", total).withColumn("share", F.round(F.col("count") / F.col("total"), 4))


def site_report(
    long: DataFrame, sessions: DataFrame, vocab: DataFrame, table: DataFrame, profiles: DataFrame, keys: Sequence[str] = SESSION,
    newest: int | None = 120, first_events: int | None = 128, floor: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """A site's ``newest`` sessions classified now: its clusters with profile and verdict, and its quality summary.

    ``sessions``: keys and last_at of the site. Only a session's ``first_events`` tokens count, as a live classifier sees them. A session
    that shares no token with any centroid, or is less like its nearest one than ``floor``, is noise. Both counts are features of the
    report; None takes all.
    """
    from pathloom.operators.clusters import classify_sessions

    if newest is not None:
        sessions = sessions.orderBy(F.desc("last_at"), *keys).limit(newest)
    own = long.join(sessions.select(*keys), on=list(keys), how="left_semi")
    if first_events is not None:
        own = own.where(F.col("pos") <= first_events)
    found = classify_sessions(own, vocab, table, keys)
    lost = (F.col("confidence") <= 0) | (F.col("confidence") < floor)
    labelled = found.withColumn("cluster", F.when(lost, F.lit(-1)).otherwise(F.col("cluster")))
    total = labelled.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    clusters, noise = site_clusters(labelled, profiles, total)
    summary = quality_summary(clusters, noise.select("noise_count").scalar(), total)
    return clusters, summary


def cluster_churn(long: DataFrame, assignments: DataFrame, churn: DataFrame, keys: Sequence[str] = SESSION) -> tuple[DataFrame, DataFrame]:
    """Per cluster: sessions, mean length, churn rate with its warning; and the five leading tokens."""
    lengths = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))
    rows = assignments.join(lengths, on=list(keys), how="left").join(churn, on=list(keys), how="left")
    rate = F.avg(F.col("is_churned").cast("double"))
    out = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("sessions"), F.round(F.avg("length"), 1).alias("avg_length"),
        F.round(rate, 4).alias("churn_rate"), (rate > 0.6).alias("at_risk"),
    )
    tokens = profile_counts(long, assignments, keys, noise=True).where(F.col("token").contains("|"))
    return out, top_k(tokens, ["cluster"], "n", "token", 5)


# Names of the prototype's clusters by event counts.
def prototype_name(events: dict[str, Column]) -> Column:
    """Name by counts of scroll_speed, tab_exit, inactivity, input_change and click."""
    return (
        F.when(events["scroll_speed"] > 1000, F.lit("Scanner (훑어보고 이탈)"))
        .when((events["tab_exit"] > 50) & (events["inactivity"] > 50), F.lit("Distracted (주의 분산형)"))
        .when((events["input_change"] > 30) | (events["click"] > 50), F.lit("Explorer (탐색형)"))
        .otherwise(F.lit("Other"))
    )
