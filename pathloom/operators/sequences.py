"""Token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import tokens as tk
from pathloom.functions.pages import with_page
from pathloom.functions.payload import slim
from pathloom.functions.rules import blank_to_null, lookup
from pathloom.operators.ordered import Keyed, known, lag, lead, ordered, prev_known, running_sum
from pathloom.operators.sessions import ORDER, SESSION
from pathloom.session import short_methods

PART = 4096


def in_parts(long: DataFrame, keys: Sequence[str], value: str, pos: str = "pos", rows: int = PART) -> DataFrame:
    """Rows numbered 1, 2, … per key as arrays of at most ``rows`` values: (keys, part, values).

    A long session becomes several parts, so no row and no group grows without bound.
    """
    part = F.floor((F.col(pos) - 1) / rows).cast("long").alias("part")
    listed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("i"), F.col(value).alias("v"))))
    return long.groupBy(*keys, part).agg(listed["v"].alias("values"))


PLACE_COLUMNS = ["event_type", "pathname", "page_url", "page_type"]
TOKEN_FIELDS = [
    "section", "element_section", "subsection_id", "subsection", "hover_text", "hover_target", "click_text", "click_target",
    "depth_pct", "milestone", "scroll_depth_pct", "max_scroll_depth", "dwell_ms", "dwell_time_ms", "hover_dwell_time_ms",
    "revisit_count", "count", "bounce_flag",
]


# --- raw events to tokens --------------------------------------------------------------------------

# Runs of these are noise and shrink to one token.
FOCUS_AWAY = ["TAB_OUT", "INACTIVE", "TAB_RETURN"]
SCROLL_NOISE = ["SCROLL_PRICE", "SCROLL_SIZE", "SCROLL_SHIPPING", "SCROLL_QA", "SCROLL_PRODUCT"]
GENERIC_NOISE = ["HOVER_ELEMENT", "CLICK_ELEMENT"]

# Intents, the marker of a repeated one, and what ends an episode.
EPISODES = {
    "CHECK_PRICE": "PRICE_REVIEW_EPISODE",
    "VIEW_REVIEW": "REVIEW_EXPLORATION_EPISODE",
    "CHECK_SHIPPING": "SHIPPING_CHECK_EPISODE",
    "CHECK_SIZE": "SIZE_CHECK_EPISODE",
}
EPISODE_WINDOW = 8
EPISODE_RESETS = "^(?:ENTER_|EXIT_|START_SESSION|ADD_CART|CLICK_BUY|CART_ABANDON|RAGE_CLICK)"


def track_place(k: Keyed, payload: str = "p", preset: str = "compat") -> Keyed:
    """Add page, section and subsection as they are known at each event.

    The page is the last one recognised. A section holds from its entry until an exit with the same
    name; the exit of another section changes nothing.
    """
    p, kind = F.col(payload), F.col("event_type")
    sub = F.coalesce(blank_to_null(p["subsection_id"]), blank_to_null(p["subsection"]))
    sec = blank_to_null(p["section"])
    k = k._with(with_page(k.df.withColumns({"__sec": sec, "__sub": sub}), "own_page", preset))
    sec, sub = F.col("__sec"), F.col("__sub")
    k = k.add(
        page=known(F.when(F.col("own_page") != "UNKNOWN", F.col("own_page"))),
        __in_sec=known(F.when(kind == "section_enter", sec)),
        __in_sub=known(F.when(kind == "subsection_enter", sub)),
    )
    left_sec = (kind == "section_exit") & (sec == F.col("__in_sec"))
    left_sub = (kind == "subsection_exit") & (sub == F.col("__in_sub"))
    k = k.add(
        section=known(F.when(kind == "section_enter", sec).when(left_sec, F.lit(""))),
        subsection=known(F.when(kind == "subsection_enter", sub).when(left_sub, F.lit(""))),
    )
    return k.cols(section=blank_to_null(F.col("section")), subsection=blank_to_null(F.col("subsection")))


def semantic_tokens(
    events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", preset: str = "compat",
    compat: bool = False, unknown: bool = False, bounded: bool = False,
) -> DataFrame:
    """Every event that leaves a token, with page, section and subsection: the audit rows."""

    def build(k: Keyed) -> DataFrame:
        k = k.where(~F.col("event_type").isin(tk.IGNORED_EVENTS))
        k = track_place(k, payload, preset)
        return tk.with_token(k.df, payload, compat, unknown).drop("own_page", "__sec", "__sub", "__in_sec", "__in_sub", payload)

    short_methods(events.sparkSession)
    return ordered(slim(events, [*keys, *ORDER, *PLACE_COLUMNS], TOKEN_FIELDS, payload), keys, ORDER, build, bounded)


# --- compression -----------------------------------------------------------------------------------


def drop_repeats(k: Keyed, token: str = "token") -> Keyed:
    """Drop a token equal to the one before it."""
    k = k.add(__before=lag(F.col(token)))
    kept = k.where(~F.col(token).eqNullSafe(F.col("__before")))
    return kept._with(kept.df.drop("__before"))


def shrink_runs(k: Keyed, token: str = "token", min_run: int = 3) -> Keyed:
    """Replace runs of ``min_run`` or more noise tokens by one token on the run's first page.

    Only the neighbours up to ``min_run`` rows away decide, so a run is never gathered.
    """
    page, semantic, _ = tk.token_parts(F.col(token))
    noise = (
        F.when(semantic.isin(FOCUS_AWAY), F.lit("away"))
        .when(semantic.isin(SCROLL_NOISE), semantic)
        .when(semantic.isin(GENERIC_NOISE), F.lit("generic"))
    )
    k = k.cols(__run=noise)
    reach = max(min_run - 1, 1)
    for i in range(1, reach + 1):
        near = "__run" if i == 1 else None
        k = k.add(
            **{
                f"__b{i}": lag(F.col(near or f"__b{i - 1}")),
                f"__f{i}": lead(F.col(near or f"__f{i - 1}")),
            }
        )

    def same(side: str, upto: int) -> Column:
        """Number of neighbours on one side that continue the run, as far as looked."""
        count, unbroken = F.lit(0), F.lit(True)
        for i in range(1, upto + 1):
            unbroken = unbroken & F.coalesce(F.col(f"__{side}{i}") == F.col("__run"), F.lit(False))
            count = count + unbroken.cast("int")
        return count

    k = k.cols(__back=same("b", reach), __ahead=same("f", reach))
    long_run = F.col("__run").isNotNull() & (F.col("__back") + 1 + F.col("__ahead") >= min_run)
    marker = (
        F.when(F.col("__run") == "away", F.concat(page, F.lit("|DISTRACTED_EPISODE|REPEAT")))
        .when(F.col("__run") == "generic", F.col(token))
        .otherwise(F.concat(page, F.lit("|"), semantic, F.lit("|SCROLLED")))
    )
    k = k.cols(**{token: F.when(long_run, marker).otherwise(F.col(token)), "__gone": long_run & (F.col("__back") > 0)})
    k = k.where(~F.col("__gone"))
    sides = [f"__{s}{i}" for s in "bf" for i in range(1, reach + 1)]
    return k._with(k.df.drop("__run", "__back", "__ahead", "__gone", *sides))


def mark_episodes(k: Keyed, token: str = "token", window: int = EPISODE_WINDOW) -> Keyed:
    """Add ``marker``: the episode token to insert after a repeated intent, else null.

    An intent seen again within the last ``window`` intents marks an episode once. The mark is
    forgotten when the intent has left the window, which is when its occurrences lie more than
    ``window`` intents apart, or at a transition. So distances between occurrences decide, and no
    list of recent intents is carried along.
    """
    parts = F.split(F.col(token), r"\|")
    page, semantic, _ = tk.token_parts(F.col(token))
    resets = (F.size(parts) != 3) | semantic.rlike(EPISODE_RESETS)
    k = k.cols(__intent=F.when(semantic.isin(list(EPISODES)), semantic))
    k = k.add(
        __epoch=running_sum(resets.cast("long")),
        __at=running_sum(F.col("__intent").isNotNull().cast("long")),
    )
    by = ["__epoch", "__intent"]
    k = k.add(by=by, __last=lag(F.col("__at")))
    apart = F.col("__at") - F.col("__last")
    turn = (
        F.when(F.col("__intent").isNull(), F.lit(None).cast("string"))
        .when(apart.isNull() | (apart > window), F.lit("new"))
        .when(apart < window, F.lit("again"))
    )
    k = k.cols(__turn=turn)
    k = k.add(by=by, __before=prev_known(F.col("__turn")))
    marked = (F.col("__turn") == "again") & (F.col("__before") == "new")
    marker = F.when(marked, F.concat(page, F.lit("|"), lookup(F.col("__intent"), EPISODES), F.lit("|STRONG")))
    k = k.cols(marker=marker)
    return k._with(k.df.drop("__intent", "__epoch", "__at", "__last", "__turn", "__before"))


def number_tokens(k: Keyed, token: str = "token", marker: str | None = "marker") -> DataFrame:
    """Rows (keys, pos, token), markers right after their token, numbered from 1."""
    if marker is None:
        k = k.add(pos=running_sum(F.lit(1).cast("long")))
        return k.df.select(*k.keys, "pos", token, *(["__chunk"] if k.chunked else []))
    width = F.when(F.col(marker).isNotNull(), 2).otherwise(1).cast("long")
    k = k.add(__end=running_sum(width)).cols(__width=width)
    first = F.col("__end") - F.col("__width")
    both = F.array(
        F.struct((first + 1).alias("pos"), F.col(token).alias("token")),
        F.struct((first + 2).alias("pos"), F.col(marker).alias("token")),
    )
    rows = k.df.select(*k.keys, *(["__chunk"] if k.chunked else []), F.explode(F.slice(both, 1, F.col("__width").cast("int"))).alias("t"))
    return rows.select(*k.keys, *(["__chunk"] if k.chunked else []), "t.pos", "t.token")


def semantic_sequences(
    events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", preset: str = "compat", compat: bool = False,
    unknown: bool = False, dedupe: bool = True, collapse: bool = True, min_run: int = 3, episodes: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """Sequences in long form: (keys, pos, token). ``in_parts`` turns them into arrays."""

    def build(k: Keyed) -> DataFrame:
        k = k.where(~F.col("event_type").isin(tk.IGNORED_EVENTS))
        k = track_place(k, payload, preset)
        k = k._with(tk.with_token(k.df, payload, compat, unknown))
        carried = [c for c in k.df.columns if c in {*keys, *ORDER, "token", "__chunk"}]
        return sequence_steps(k._with(k.df.select(*carried)), dedupe, collapse, min_run, episodes)

    short_methods(events.sparkSession)
    return ordered(slim(events, [*keys, *ORDER, *PLACE_COLUMNS], TOKEN_FIELDS, payload), keys, ORDER, build, bounded)


def sequence_steps(k: Keyed, dedupe: bool = True, collapse: bool = True, min_run: int = 3, episodes: bool = True) -> DataFrame:
    """Drop repeats, shrink runs, mark episodes, number."""
    if dedupe:
        k = drop_repeats(k)
    if collapse:
        k = shrink_runs(k, min_run=min_run)
    if episodes:
        return number_tokens(mark_episodes(k))
    return number_tokens(k, marker=None)


def compress(
    tokens: DataFrame, keys: Sequence[str], order: Sequence[str], dedupe: bool = True, collapse: bool = True,
    min_run: int = 3, episodes: bool = True, bounded: bool = False,
) -> DataFrame:
    """The compression alone, for rows that already carry ``token``."""
    return ordered(
        tokens.select(*keys, *order, "token"), keys, order,
        lambda k: sequence_steps(k, dedupe, collapse, min_run, episodes), bounded,
    )


def sequence_summary(events: DataFrame, long: DataFrame, keys: Sequence[str] = SESSION, max_unknown: float | None = 0.5) -> DataFrame:
    """Start, end and length of every session; sessions with too many tokens of unknown pages are left out."""
    spans = events.groupBy(*keys).agg(
        F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"), F.lit(0).alias("__n"), F.lit(0).alias("__u")
    )
    tokens = long.groupBy(*keys).agg(
        F.lit(None).cast("long").alias("start_timestamp"), F.lit(None).cast("long").alias("end_timestamp"),
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("token").startswith("UNKNOWN|")).alias("__u"),
    )
    both = spans.unionByName(tokens).groupBy(*keys).agg(
        F.max("start_timestamp").alias("start_timestamp"), F.max("end_timestamp").alias("end_timestamp"),
        F.sum("__n").alias("length"), F.sum("__u").alias("__u"),
    )
    if max_unknown is not None:
        both = both.where((F.col("length") == 0) | (F.col("__u") / F.col("length") <= max_unknown))
    return both.drop("__u")


def unknown_ratio(long: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    n = F.count(F.lit(1))
    return long.groupBy(*keys).agg(
        n.alias("length"), (F.count_if(F.col("token").startswith("UNKNOWN|")) / n).alias("unknown_ratio")
    )


def at_least(long: DataFrame, length: int, keys: Sequence[str] = SESSION) -> DataFrame:
    """Rows of the sequences with at least ``length`` tokens."""
    keep = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= length)
    return long.join(keep.select(*keys), on=list(keys), how="left_semi")


def token_lists(sequences: DataFrame, text: str, key: str = "session_id") -> DataFrame:
    """Space-joined sequences as rows (key, pos, token)."""
    words = F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != "")
    return sequences.select(key, F.posexplode(words).alias("__i", "token")).select(
        key, (F.col("__i") + 1).cast("long").alias("pos"), "token"
    )


def remap_tokens(long: DataFrame, known_tokens: DataFrame, mapping: dict[str, str], keys: Sequence[str] = SESSION, bounded: bool = False):
    """Tokens in another vocabulary: kept when known, mapped by the table, else dropped; renumbered.

    Returns the sequences and, per key, how many tokens were dropped.
    """
    special = F.col("token").isin("[PAD]", "[CLS]", "[UNK]", "[MASK]")
    names = known_tokens.select("token").distinct().withColumn("__known", F.lit(True))
    mapped = F.when(F.col("__known"), F.col("token")).otherwise(F.nullif(lookup(F.col("token"), mapping), F.lit("[UNK]")))
    rows = long.where(~special).join(names, on="token", how="left").withColumn("__to", mapped)
    dropped = rows.groupBy(*keys).agg(F.count_if(F.col("__to").isNull()).alias("unk_count"))
    kept = rows.where(F.col("__to").isNotNull()).select(*keys, F.col("pos").alias("__pos"), F.col("__to").alias("token"))
    out = ordered(
        kept, keys, ["__pos"], lambda k: k.add(pos=running_sum(F.lit(1).cast("long"))).df, bounded
    ).drop("__pos")
    return out, dropped


def event_sequences(events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", bounded: bool = False) -> DataFrame:
    """Raw event types in order, scroll depths appended: (keys, pos, token)."""
    depth = F.coalesce(F.col(payload)["depth_pct"], F.lit(0.0)).cast("int").cast("string")
    name = F.when(F.col("event_type") == "scroll_depth", F.concat(F.lit("scroll_"), depth)).otherwise(F.col("event_type"))
    rows = events.withColumn("token", name)
    return ordered(
        rows, keys, ORDER, lambda k: k.add(pos=running_sum(F.lit(1).cast("long"))).df, bounded
    ).select(*keys, "pos", "token")


# --- audit -----------------------------------------------------------------------------------------


def sequence_audit(audit: DataFrame) -> DataFrame:
    """Counts of the audit rows along seven dimensions, in one pass: (dimension, value, n)."""
    page, semantic, context = tk.token_parts(F.col("token"))
    dims = {
        "token": F.col("token"),
        "event": F.coalesce(F.col("event_type"), F.lit("UNKNOWN_EVENT_TYPE")),
        "page": F.coalesce(F.col("page"), F.lit("UNKNOWN_PAGE")),
        "section": F.coalesce(F.col("section"), F.lit("NO_SECTION")),
        "semantic": semantic,
        "contextual": context,
        "unknown_event": F.when(F.col("token").contains("UNKNOWN_EVENT"), F.col("event_type")),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in dims.items())))
    return (
        audit.select(pairs.alias("d")).where(F.col("d.value").isNotNull())
        .groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
    )


def top_tokens_by(audit: DataFrame, by: Column, k: int = 10) -> DataFrame:
    """The ``k`` most frequent tokens per value of ``by``."""
    counts = audit.groupBy(by.alias("group"), "token").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["group"], "n", "token", k)


def top_k(counts: DataFrame, by: Sequence[str], count: str, name: str, k: int) -> DataFrame:
    """The ``k`` largest counts per group, ties by name; Spark limits groups before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc(count), F.asc(name))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def session_lengths(long: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))


def length_summary(lengths: DataFrame) -> DataFrame:
    return lengths.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("length") > 0).alias("non_empty"),
        F.sum("length").alias("tokens"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.round(F.avg("length"), 2).alias("avg_length"),
        F.count_if(F.col("length") >= 100).alias("long_sessions"),
        F.count_if(F.col("length") <= 2).alias("short_sessions"),
    )


def length_histogram(lengths: DataFrame, bins: int = 20) -> DataFrame:
    """Sessions per length bin of equal width, as a histogram plot would show them: (bin, low, n)."""
    by_length = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    span = by_length.agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    width = F.greatest((hi - lo) / bins, F.lit(1e-9))
    at = F.least(F.floor((F.col("length") - lo) / width), F.lit(bins - 1)).cast("int")
    return by_length.groupBy(at.alias("bin")).agg(F.sum("n").alias("n"))
