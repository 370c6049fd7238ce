"""Derived behaviour: what the order of a session's events says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.ordered import (
    Fold,
    Keyed,
    fold,
    hot_keys,
    known,
    lag,
    lead,
    next_known,
    ordered,
    prev_known,
    running_min,
    running_sum,
)
from pathloom.operators.sessions import ORDER, SESSION

def one() -> Column:
    return F.lit(1).cast("long")


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def time_to_first_click(events: DataFrame, keys: Sequence[str] = SESSION, bounded: bool = False) -> DataFrame:
    """Per page visit: milliseconds from entering the page to its first click, where there is one."""

    def build(k: Keyed) -> DataFrame:
        enters = _is("navigation", "session_start")
        k = k.add(
            visit=running_sum(enters.cast("long")),
            enter_ts=known(F.when(enters, F.col("timestamp"))),
        )
        return k.df

    visits = ordered(events, keys, ORDER, build, bounded)
    clicks = visits.where(_is("click") & F.col("enter_ts").isNotNull())
    return clicks.groupBy(*keys, "visit").agg(F.min(F.col("timestamp") - F.col("enter_ts")).alias("duration_ms"))


def inactivity_spans(
    events: DataFrame, keys: Sequence[str] = SESSION, idle_ms: int = 10_000, bounded: bool = False
) -> DataFrame:
    """Silences of ``idle_ms`` or more before the next activity or the session's end.

    Activity is anything but the derived inactivity event; a session end closes a silence but is none.
    """

    def build(k: Keyed) -> DataFrame:
        active = ~_is("inactivity", "session_end")
        k = k.where(~_is("inactivity")).add(__last=prev_known(F.when(active, F.col("timestamp"))))
        return k.df

    rows = ordered(events, keys, ORDER, build, bounded)
    start = F.col("__last") + idle_ms
    return rows.where(F.col("timestamp") >= start).select(
        *keys,
        start.alias("inactivity_start_time"),
        (F.col("timestamp") - start).alias("inactivity_duration"),
    )


def cart_state(events: DataFrame, keys: Sequence[str] = SESSION, bounded: bool = False) -> DataFrame:
    """Items in the cart after each cart event: +1, −1 but never below 0, emptied by a purchase.

    A count floored at 0 equals the running sum minus its lowest value so far (if below 0), within
    the stretch since the last purchase.
    """

    def build(k: Keyed) -> DataFrame:
        step = F.when(_is("add_to_cart"), 1).when(_is("remove_from_cart"), -1).otherwise(0).cast("long")
        k = k.add(__epoch=running_sum(_is("purchase_click").cast("long")))
        k = k.add(by=["__epoch"], __sum=running_sum(step))
        k = k.add(by=["__epoch"], __low=running_min(F.col("__sum")))
        count = F.col("__sum") - F.least(F.lit(0).cast("long"), F.col("__low"))
        return k.df.withColumn("cart_count", count).drop("__epoch", "__sum", "__low")

    cart = events.where(_is("add_to_cart", "remove_from_cart", "purchase_click"))
    return ordered(cart, keys, ORDER, build, bounded)


def cart_abandonment(events: DataFrame, keys: Sequence[str] = SESSION, bounded: bool = False) -> DataFrame:
    """Sessions that end with something in the cart."""
    last = cart_state(events, keys, bounded).groupBy(*keys).agg(
        F.max_by("cart_count", F.struct(*ORDER)).alias("cart_item_count")
    )
    return last.where("cart_item_count > 0").withColumn("cart_abandon_flag", F.lit(True))


def nth(events: DataFrame, by: Sequence[str], name: str = "nth", keys: Sequence[str] = SESSION, bounded: bool = False) -> DataFrame:
    """How often this has happened so far, per ``by`` within the session."""
    return ordered(events, keys, ORDER, lambda k: k.add(by=by, **{name: running_sum(one())}).df, bounded)


def section_revisits(events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", bounded: bool = False) -> DataFrame:
    """Second and later entries into the same section."""
    enters = events.where(_is("section_enter")).withColumn("section", F.col(payload)["section"])
    return nth(enters, ["section"], "count", keys, bounded).where("count > 1")


def section_transitions(events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", bounded: bool = False) -> DataFrame:
    """Entries into another section than the one entered before."""
    enters = events.where(_is("section_enter")).withColumn("to", F.col(payload)["section"])
    rows = ordered(enters, keys, ORDER, lambda k: k.add(**{"from": lag(F.col("to"))}).df, bounded)
    return rows.where(F.col("from") != F.col("to"))


def subsection_dwell(events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", bounded: bool = False) -> DataFrame:
    """Exit minus the latest entry into the same subsection; an exit without an open entry yields nothing.

    A page change closes all open entries.
    """
    rows = events.where(_is("subsection_enter", "subsection_exit", "navigation")).withColumn(
        "subsection_id", F.col(payload)["subsection_id"]
    )

    def build(k: Keyed) -> DataFrame:
        k = k.add(__page=running_sum(_is("navigation").cast("long")))
        k = k.add(
            by=["__page", "subsection_id"],
            __prev_type=lag(F.col("event_type")),
            __prev_ts=lag(F.col("timestamp")),
        )
        return k.df

    paired = ordered(rows, keys, ORDER, build, bounded)
    return paired.where(_is("subsection_exit") & (F.col("__prev_type") == "subsection_enter")).withColumn(
        "dwell_ms", F.col("timestamp") - F.col("__prev_ts")
    ).drop("__page", "__prev_type", "__prev_ts")


def tab_away(events: DataFrame, keys: Sequence[str] = SESSION, bounded: bool = False) -> DataFrame:
    """Milliseconds between leaving the tab and returning; null when there was no open exit."""
    rows = events.where(_is("tab_exit", "tab_return"))

    def build(k: Keyed) -> DataFrame:
        return k.add(__type=lag(F.col("event_type")), __ts=lag(F.col("timestamp"))).df

    out = ordered(rows, keys, ORDER, build, bounded).where(_is("tab_return"))
    away = F.when(F.col("__type") == "tab_exit", F.col("timestamp") - F.col("__ts"))
    return out.withColumn("tab_exit_duration_ms", away).drop("__type", "__ts")


def milestones(
    values: DataFrame, value: str, steps: Sequence[int], keys: Sequence[str], skip_first: bool = True, bounded: bool = False
) -> DataFrame:
    """First time that ``value`` reaches each step, per key; the first row only sets the base."""
    rank = F.struct(*ORDER)
    rows = values
    if skip_first:
        first = values.groupBy(*keys).agg(F.min(rank).alias("__first"))
        rows = values.join(first, on=list(keys)).where(rank > F.col("__first"))
    reached = rows.select(
        *keys, rank.alias("__at"),
        F.explode(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col(value))).alias("milestone"),
    )
    return reached.groupBy(*keys, "milestone").agg(F.min("__at").alias("__at")).select(
        *keys, "milestone", "__at.timestamp", "__at.event_id"
    )


def direction_changes(
    scrolls: DataFrame, y: str, keys: Sequence[str] = SESSION, skip_first: bool = True, bounded: bool = False
) -> DataFrame:
    """Flips between up and down; no movement counts as up. The first scroll sets only the depth base."""

    def build(k: Keyed) -> DataFrame:
        k = k.add(__row=running_sum(one()))
        if skip_first:
            k = k.where(F.col("__row") > 1)
        k = k.add(__y=lag(F.col(y)))
        k = k.cols(to=F.when(F.col(y) > F.coalesce(F.col("__y"), F.lit(0.0)), F.lit("down")).otherwise("up"))
        return k.add(**{"from": lag(F.col("to"))}).df.drop("__row", "__y")

    return ordered(scrolls, keys, ORDER, build, bounded).where(F.col("from") != F.col("to"))


def debounce_last(
    inputs: DataFrame, field: str, length: str, keys: Sequence[str] = SESSION, wait_ms: int = 300, bounded: bool = False
) -> DataFrame:
    """Inputs with no follower in the same field within ``wait_ms``; empty inputs are not looked at."""
    rows = ordered(
        inputs.where(F.col(length) > 0), keys, ORDER, lambda k: k.add(by=[field], __next=lead(F.col("timestamp"))).df, bounded
    )
    return rows.where(F.col("__next").isNull() | (F.col("__next") - F.col("timestamp") >= wait_ms)).drop("__next")


def nav_paths(events: DataFrame, keys: Sequence[str] = SESSION, bounded: bool = False) -> DataFrame:
    """Each navigation with its depth in the session and the page before.

    The path so far is the session's navigations up to that depth, see ``sequences.in_parts``.
    """
    rows = events.where(_is("navigation"))
    return ordered(
        rows, keys, ORDER, lambda k: k.add(page_depth=running_sum(one()), previous=lag(F.col("pathname"))).df, bounded
    )


def page_dwell(events: DataFrame, keys: Sequence[str] = SESSION, bounded: bool = False) -> DataFrame:
    """Time on each page visit: until the next navigation, the last one until the session's last event."""

    def build(k: Keyed) -> DataFrame:
        return k.add(visit=running_sum(_is("navigation").cast("long"))).df

    visits = ordered(events, keys, ORDER, build, bounded).groupBy(*keys, "visit").agg(
        F.min("timestamp").alias("enter_ts"),
        F.max("timestamp").alias("last_ts"),
        F.min_by("pathname", F.struct(*ORDER)).alias("pathname"),
    )
    out = ordered(
        visits, keys, ["visit"], lambda k: k.add(__next=lead(F.col("enter_ts"))).df, bounded
    )
    return out.withColumn("page_dwell_time", F.coalesce(F.col("__next"), F.col("last_ts")) - F.col("enter_ts")).drop("__next")


# Events that count as interaction with the page.
PASSIVE = ["session_start", "session_end", "navigation", "inactivity", "bounce", "tab_exit", "tab_return"]


def bounce_flags(events: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Sessions with one page and no interaction."""
    return events.groupBy(*keys).agg(
        ((F.count_if(_is("navigation")) <= 1) & (F.count_if(~_is(*PASSIVE)) == 0)).alias("bounce_flag")
    )


def exit_records(events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p") -> DataFrame:
    """What is known when a session ends: exit page, depth, bounce, last activity and scroll position."""
    rank = F.struct(*ORDER)
    y = F.coalesce(F.col(payload)["last_viewport_scrollY"], F.col(payload)["position"])
    return events.groupBy(*keys).agg(
        F.max_by("pathname", rank).alias("exit_page"),
        F.max("timestamp").alias("last_event_time"),
        F.count_if(_is("navigation")).alias("page_depth"),
        ((F.count_if(_is("navigation")) <= 1) & (F.count_if(~_is(*PASSIVE)) == 0)).alias("bounce_flag"),
        F.max_by(y, F.when(y.isNotNull(), rank)).cast("long").alias("last_scroll_y"),
    )


def option_changes(
    events: DataFrame, keys: Sequence[str] = SESSION, payload: str = "p", bounded: bool = False
) -> DataFrame:
    """Another value of the same option than before, with a running number."""
    rows = events.where(_is("option_select", "option_change")).withColumns(
        {n: F.col(payload)[n] for n in ("option_name", "option_value")}
    )

    def build(k: Keyed) -> DataFrame:
        k = k.add(by=["option_name"], __prev=lag(F.col("option_value")))
        changed = F.coalesce(F.col("__prev") != F.col("option_value"), F.lit(False))
        return k.add(by=["option_name"], change_count=running_sum(changed.cast("long"))).df.withColumn("__c", changed)

    return ordered(rows, keys, ORDER, build, bounded).where("__c").drop("__c", "__prev")


def motion_summary(positions: DataFrame, keys: Sequence[str], window_ms: int = 2_000, bounded: bool = False) -> DataFrame:
    """Distance and direction flips of pointer positions (x, y) per window of ``window_ms``."""

    def build(k: Keyed) -> DataFrame:
        k = k.add(__x=lag(F.col("x")), __y=lag(F.col("y")))
        dx, dy = F.col("x") - F.col("__x"), F.col("y") - F.col("__y")
        k = k.cols(
            __dist=F.sqrt(dx * dx + dy * dy),
            __dir=F.when(dx.isNotNull(), F.concat_ws(",", F.signum(dx).cast("int").cast("string"), F.signum(dy).cast("int").cast("string"))),
        )
        return k.add(__before=lag(F.col("__dir"))).df

    moves = ordered(positions, keys, ORDER, build, bounded)
    slot = (F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(window_ms))).alias("window_start")
    out = moves.groupBy(*keys, slot).agg(
        F.round(F.sum("__dist")).cast("long").alias("distance_px"),
        F.count_if(F.col("__before") != F.col("__dir")).alias("jitter_count"),
    )
    return out.where("distance_px > 0")


# --- folds ---------------------------------------------------------------------------------------
#
# A fold's next step depends on its own last output, so it walks rows in Python. But its state starts afresh at many rows, whatever
# came before: after a long pause, a new path, a far jump. Windows find these rows, which cut a key into stretches, and find the
# stretches in which something can happen; only those are walked, each on its own, so a hot key becomes many small ones.

_LONG, _DOUBLE, _STRING = T.LongType(), T.DoubleType(), T.StringType()
STRETCH = "__stretch"


def _stretches(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], before: dict[str, Column], fresh: Column, stirs: Column, bounded: bool
) -> DataFrame:
    """``values`` with the number of the stretch, whether the row is ``__fresh``, and whether its stretch is ``__alive``.

    ``before`` names steps on neighbours (one after the other), which ``fresh`` and ``stirs`` read; a stretch is alive if a row stirs.
    """
    own = [*keys, *values, *(c for c in ["event_seq"] if c in df.columns)]

    def build(k: Keyed) -> DataFrame:
        for name, step in before.items():
            k = k.add(**{name: step})
        k = k.cols(__fresh=F.coalesce(fresh, F.lit(False)), __stirs=F.when(F.coalesce(stirs, F.lit(False)), True))
        k = k.add(**{STRETCH: running_sum(F.col("__fresh").cast("long"))})
        k = k.add(by=[STRETCH], __so_far=known(F.col("__stirs")), __later=next_known(F.col("__stirs")))
        return k.cols(__alive=F.coalesce("__so_far", "__later").isNotNull()).df

    return ordered(df.select(*dict.fromkeys(own)), keys, ORDER, build, bounded).drop(*before, "__stirs", "__so_far", "__later")


def _within_bound(df: DataFrame, keys: Sequence[str], bounded: bool) -> bool:
    """Whether every key, and so every stretch of it, has as few rows as one task may order; said once, the stretches need no count."""
    return bounded or hot_keys(df, keys) is None


def _walk(rows: DataFrame, keys: Sequence[str], values: Sequence[str], step: Fold, out: T.StructType, bounded: bool) -> DataFrame:
    return fold(rows, [*keys, STRETCH], ORDER, values, step, out, bounded).drop(STRETCH)


def click_point(payload: Column) -> tuple[Column, Column]:
    """Where a click was: its ``click_position``, else ``x`` and ``y``, else 0."""
    nested = payload["click_position"]
    return F.coalesce(nested["x"], payload["x"], F.lit(0.0)), F.coalesce(nested["y"], payload["y"], F.lit(0.0))


def rage_step(window_ms: int, radius: float, times: int, cooldown_ms: int) -> Fold:
    """One click: (state, (timestamp, event_id, x, y)) to the new state and the click that fires, if it does."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        ts, event_id, x, y = row
        fired = state.get("fired")
        if fired is not None and ts - fired < cooldown_ms:
            return {"fired": fired}, []
        recent = [c for c in state.get("recent", []) if ts - c[0] < window_ms]
        if any(abs(c[1] - x) > radius or abs(c[2] - y) > radius for c in recent):
            recent = []
        recent.append([int(ts), float(x), float(y)])
        if len(recent) < times:
            return {"recent": recent, **({} if fired is None else {"fired": fired})}, []
        return {"fired": int(ts)}, [(int(ts), event_id, float(x), float(y), len(recent))]

    return step


def rage_clicks(
    clicks: DataFrame, keys: Sequence[str] = SESSION, window_ms: int = 500, radius: float = 20, times: int = 3,
    cooldown_ms: int = 1_000, bounded: bool = False,
) -> DataFrame:
    """``times`` clicks within ``window_ms`` near the newest one; then a pause. Needs timestamp, event_id, x, y (see ``click_point``)."""
    step = rage_step(window_ms, radius, times, cooldown_ms)
    out = T.StructType([
        T.StructField("timestamp", _LONG), clicks.schema["event_id"], T.StructField("x", _DOUBLE),
        T.StructField("y", _DOUBLE), T.StructField("click_count", _LONG),
    ])
    values = [*ORDER, "x", "y"]
    bounded = _within_bound(clicks, keys, bounded)
    before = {f"__t{i}": lag(F.col(f"__t{i - 1}" if i > 1 else "timestamp")) for i in range(1, max(2, times))}
    fresh = F.col("timestamp") - F.col("__t1") >= max(window_ms, cooldown_ms)
    dense = F.col("timestamp") - F.col(f"__t{times - 1}") < window_ms if times > 1 else F.lit(True)
    rows = _stretches(clicks, keys, values, before, fresh, dense, bounded)
    return _walk(rows.where("__alive"), keys, values, step, out, bounded)


def thin_by_delta(
    values: DataFrame, value: str, keys: Sequence[str] = SESSION, delta: float = 5, first_is_base: bool = True,
    bounded: bool = False,
) -> DataFrame:
    """Rows that differ by ``delta`` or more from the last row kept. The first only sets the base."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        ts, event_id, v, later = row
        base = state.get("base")
        if base is None and later:
            return {"base": float(v)}, [(int(ts), event_id, float(v))]
        if base is None and first_is_base:
            return {"base": float(v)}, []
        if abs(v - (-1 if base is None else base)) >= delta:
            return {"base": float(v)}, [(int(ts), event_id, float(v))]
        return state, []

    out = T.StructType([
        T.StructField("timestamp", _LONG), values.schema["event_id"], T.StructField(value, _DOUBLE),
    ])
    v = F.col(value)
    # the base lies within delta of the row before, so a jump of twice that is kept for certain
    jump = F.abs(v - F.col("__v")) > 2 * delta * (1 + 1e-6)
    again = F.coalesce(F.col("__v").isNotNull() & ~jump, F.lit(False))
    rows = _stretches(values.where(v.isNotNull()), keys, [*ORDER, value], {"__v": lag(v)}, jump, again, bounded)
    later = rows.where("__alive").withColumn("__later", F.col(STRETCH) > 0)
    walked = _walk(later, keys, [*ORDER, value, "__later"], step, out, bounded)
    alone = (F.col(STRETCH) > 0) | (F.lit(not first_is_base) & (F.abs(v + 1) >= delta))
    quiet = rows.where(~F.col("__alive") & alone).select(*keys, "timestamp", "event_id", v.cast("double").alias(value))
    return walked.unionByName(quiet)


def throttled_speed(
    scrolls: DataFrame, y: str, keys: Sequence[str] = SESSION, every_ms: int = 1_000, min_px: float = 50, bounded: bool = False
) -> DataFrame:
    """Mean scroll speed over windows of at least ``every_ms`` that moved at least ``min_px``."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        ts, event_id, at = row
        if not state:
            return {"t": int(ts), "y": float(at)}, []
        dt, dy = ts - state["t"], abs(at - state["y"])
        if dt < every_ms:
            return state, []
        moved = [(int(ts), event_id, round(float(dy / dt), 3), float(dy), int(dt))] if dy >= min_px else []
        return {"t": int(ts), "y": float(at)}, moved

    out = T.StructType([
        T.StructField("timestamp", _LONG), scrolls.schema["event_id"], T.StructField("speed", _DOUBLE),
        T.StructField("distance_px", _DOUBLE), T.StructField("duration_ms", _LONG),
    ])
    values = [*ORDER, y]
    pause = F.col("timestamp") - F.col("__t") >= every_ms
    moves = F.lit(True) if min_px <= 0 else F.col("__next") != F.col(y)
    rows = _stretches(
        scrolls.where(F.col(y).isNotNull()), keys, values, {"__t": lag(F.col("timestamp")), "__next": lead(F.col(y))}, pause, moves, bounded
    )
    # the row after a pause ends the stretch before it, too; the first row of a stretch only sets the state. A stretch is alive by
    # its rows' next ones, so the row that ends it comes along if the row before it is alive
    rows = ordered(rows, keys, ORDER, lambda k: k.add(__before=lag(F.col("__alive"))).df, bounded)
    ends = rows.where(F.col("__fresh") & F.col("__before")).withColumn(STRETCH, F.col(STRETCH) - 1)
    return _walk(rows.where("__alive").unionByName(ends), keys, values, step, out, bounded)


def suppress_repeats(
    navigations: DataFrame, keys: Sequence[str] = SESSION, within_ms: int = 100, bounded: bool = False
) -> DataFrame:
    """Navigations without those to the path last kept less than ``within_ms`` before."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        ts, event_id, path = row
        if state and state["path"] == path and ts - state["ts"] < within_ms:
            return state, []
        return {"path": path, "ts": int(ts)}, [(int(ts), event_id, path)]

    out = T.StructType([
        T.StructField("timestamp", _LONG), navigations.schema["event_id"], T.StructField("pathname", _STRING),
    ])
    values = [*ORDER, "pathname"]
    # the path last kept is that of the row before, and was kept no later
    other = ~F.col("pathname").eqNullSafe(F.col("__path")) | (F.col("timestamp") - F.col("__t") >= within_ms)
    before = {"__t": lag(F.col("timestamp")), "__path": lag(F.col("pathname"))}
    rows = _stretches(navigations, keys, values, before, F.col("__t").isNotNull() & other, F.col("__t").isNotNull() & ~other, bounded)
    walked = _walk(rows.where("__alive"), keys, values, step, out, bounded)
    quiet = rows.where(~F.col("__alive")).select(*keys, "timestamp", "event_id", "pathname")
    return walked.unionByName(quiet)


# --- intents ---------------------------------------------------------------------------------------

# Which outcomes close which kind of intent.
OUTCOMES = {
    "cart_intent": ["add_to_cart_success", "cart_action_error"],
    "wishlist_intent": ["add_to_wishlist_success", "remove_from_wishlist_success", "wishlist_login_required"],
}


def resolve_intents(
    events: DataFrame, outcomes: dict[str, Sequence[str]] = OUTCOMES, keys: Sequence[str] = SESSION,
    within_ms: int | None = None, bounded: bool = False,
) -> DataFrame:
    """Each intent with the first outcome before the next intent of its kind (and ``within_ms``, if given).

    A forward look in one ordered pass, no join of intents with outcomes.
    """
    kind = F.lit(None).cast("string")
    for intent, closing in outcomes.items():
        kind = F.when(_is(intent, *closing), F.lit(intent)).otherwise(kind)
    rows = events.withColumn("intent", kind).where(F.col("intent").isNotNull())

    def build(k: Keyed) -> DataFrame:
        opens = F.col("event_type") == F.col("intent")
        k = k.add(
            by=["intent"],
            __outcome=next_known(F.when(~opens, F.struct("timestamp", "event_id", "event_type"))),
            __next=next_known(F.when(opens, F.struct("timestamp", "event_id"))),
        )
        return k.df.where(opens)

    open_ = ordered(rows, keys, ORDER, build, bounded)
    found = F.col("__outcome").isNotNull() & (
        F.col("__next").isNull()
        | (F.struct("__outcome.timestamp", "__outcome.event_id") < F.col("__next"))
    )
    if within_ms is not None:
        found = found & (F.col("__outcome.timestamp") - F.col("timestamp") < within_ms)
    return open_.select(
        *keys, "intent", "timestamp", "event_id",
        F.when(found, F.col("__outcome.event_type")).alias("outcome"),
        F.when(found, F.col("__outcome.timestamp") - F.col("timestamp")).alias("wait_ms"),
    )
