"""Behaviour of sessions while they are open: one stateful processor per user, with event-time timers.

Events wait until the watermark has passed them and are then walked in event order, so the output does not depend on the order
of arrival. Deadlines (silence, session timeout, end of a window) are timers: they fire once the watermark passes them, without a
further event. What a walk does is a ``Walk``: a plain state and three functions of it. A user's state holds the waiting events
of one delay and the open session, nothing of closed ones.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pathloom.operators.behaviour import PASSIVE, click_point, rage_step
from pathloom.operators.sessions import TTL_MS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACK = 1_000  # waiting events in one value of the state
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


class Walk:
    """What happens to a user's events in order. ``state`` is JSON; rows are dicts of the output's columns."""

    def event(self, state: dict, e: dict) -> Iterator[dict]:
        raise NotImplementedError

    def deadline(self, state: dict) -> int | None:
        """The next time at which something happens by itself."""
        return None

    def expire(self, state: dict, at: int) -> Iterator[dict]:
        return iter(())


class _Walker(StatefulProcessor):
    def __init__(self, walk: Walk, key: str, waiting: T.StructType, columns: Sequence[str]):
        self.walk, self.key, self.schema, self.columns = walk, key, waiting, list(columns)
        self.whole = [isinstance(f.dataType, T.IntegralType) for f in waiting.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a value holds many events: each value of a state passes between Python and the JVM by itself
        self.waiting = handle.getListState("waiting", "events binary")
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            # the watermark is past these; ``late.split`` keeps them elsewhere
            new = [tuple(map(_plain, r, self.whole)) for r in pdf[self.schema.names].itertuples(index=False) if r[0] > passed]
            if new:
                self.waiting.appendList(_packed(new))
                first = min(r[0] for r in new) if first is None else min(first, *(r[0] for r in new))
        if first is not None:
            state = self._load()
            self._wake(state, first)
            self._save(state)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, state = timerValues.getCurrentWatermarkInMs(), self._load()
        state.pop("__timer", None)
        held = [r for pack in self.waiting.get() for r in pickle.loads(pack[0])] if self.waiting.exists() else []
        ready = sorted((r for r in held if r[0] <= passed), key=lambda r: r[:2])
        later = [r for r in held if r[0] > passed]
        out = []
        for row in ready:
            out += self._expire(state, row[0])
            out += self.walk.event(state, dict(zip(self.schema.names, row)))
        out += self._expire(state, passed)
        if ready:
            self.waiting.put(_packed(later)) if later else self.waiting.clear()
        wakes = [t for t in (self.walk.deadline(state), min((r[0] for r in later), default=None)) if t is not None]
        if wakes:
            self._wake(state, min(wakes))
        if state:
            self._save(state)
        else:
            self.state.clear()
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _expire(self, state: dict, upto: int) -> list[dict]:
        out, at = [], self.walk.deadline(state)
        while at is not None and at <= upto:
            out += self.walk.expire(state, at)
            at = self.walk.deadline(state)
        return out

    def _wake(self, state: dict, at: int) -> None:
        set_for = state.get("__timer")
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(at)
            state["__timer"] = at

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {}

    def _save(self, state: dict) -> None:
        self.state.update((json.dumps(state),))

    def _frame(self, key, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{self.key: key[0], **r} for r in rows], columns=[self.key, *self.columns], dtype=object)


def _packed(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[i : i + PACK]),) for i in range(0, len(rows), PACK)]


def _plain(v, whole: bool):
    """A value as Python knows it: pandas turns whole numbers into floats where others are null, and nulls into NaN."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if whole else v


def walked(events: DataFrame, walk: Walk, out: str, user: str = "user_id", time: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Rows of ``walk`` over each user's events. ``events`` holds user, timestamp (ms), event_id and what the walk reads.

    An event without id or time is not walked. Events of one user go through one task, in batches, and wait in the state for one
    ``delay``; users are spread over all tasks. Needs RocksDB as state store, which this sets for the session if unset.
    """
    use_rocks(events.sparkSession)
    names = ["timestamp", "event_id", *(c for c in events.columns if c not in (user, time, "timestamp", "event_id"))]
    rows = events.where(F.col("event_id").isNotNull()).withWatermark(time, delay)
    waiting = rows.select(*names).schema
    fields = T._parse_datatype_string(out).fields
    result = T.StructType([events.schema[user], *fields])
    return rows.groupBy(user).transformWithStateInPandas(
        _Walker(walk, user, waiting, [f.name for f in fields]), result, "Append", "EventTime"
    )


def use_rocks(spark: SparkSession) -> None:
    """Timers need the RocksDB store; a provider that the session names itself stays."""
    if "RocksDB" not in spark.conf.get(PROVIDER_CONF, ""):
        spark.conf.set(PROVIDER_CONF, ROCKS)


# --- sessions -------------------------------------------------------------------------------------

#: One row per thing that happened. ``kind``: session_start, session_end, page, idle, inactivity, cart, rage_click, first_click, revisit, option.
LIVE = (
    "started_at long, kind string, timestamp long, event_id {id}, name string, number long, duration_ms long, depth long, "
    "bounce boolean, scroll_y long, source string, exit_reason string"
)


def live_rows(events: DataFrame, user: str = "user_id", time: str = "event_time", payload: str = "p") -> DataFrame:
    """The columns that ``Session`` reads, from events with a parsed payload."""
    p = F.col(payload)
    x, y = click_point(p)
    return events.select(
        user, time, "timestamp", "event_id", "event_type", "pathname", "utm_source", p["section"].alias("section"),
        p["option_name"].alias("option_name"), p["option_value"].alias("option_value"), x.alias("x"), y.alias("y"),
        F.coalesce(p["last_viewport_scrollY"], p["position"]).cast("long").alias("scroll_y"),
    )


class Session(Walk):
    """Sessions by timeout, and what their events say while they are open.

    * ``session_start`` with the first event, ``session_end`` at the timeout with exit page, depth, bounce, last scroll and cart;
    * ``page`` when a page is left or its session ends, with the time spent there;
    * ``idle`` when ``idle_ms`` pass in silence, ``inactivity`` when the next event ends that;
    * ``cart``, ``rage_click``, ``first_click`` of a page, ``revisit`` of a section and ``option`` changes with their event.

    The rules are those of ``operators.behaviour``. Clicks of ``rage_types`` count for rage clicks; None means every event.
    """

    def __init__(
        self, ttl_ms: int = TTL_MS, idle_ms: int = 10_000, window_ms: int = 500, radius: float = 20, times: int = 3,
        cooldown_ms: int = 1_000, rage_types: Sequence[str] | None = ("click",),
    ):
        self.ttl_ms, self.idle_ms = ttl_ms, idle_ms
        self.rage, self.rage_types = rage_step(window_ms, radius, times, cooldown_ms), rage_types

    def _row(self, s: dict, kind: str, at: int, e: dict | None = None, **values) -> dict:
        return {"started_at": s["start"], "kind": kind, "timestamp": at, "event_id": e["event_id"] if e else None, **values}

    def event(self, s: dict, e: dict) -> Iterator[dict]:
        ts, kind = e["timestamp"], e["event_type"]
        if "start" not in s:
            s.update(start=ts, events=0, pages=0, active=False, cart=0, visit=0, sections={}, options={}, rage={}, source=e["utm_source"])
            yield self._row(s, "session_start", ts, e, name=e["pathname"], source=e["utm_source"])
        yield from self._page(s, e)
        yield from self._silence(s, e)
        if kind in ("add_to_cart", "remove_from_cart", "purchase_click"):
            s["cart"] = {"add_to_cart": s["cart"] + 1, "remove_from_cart": max(0, s["cart"] - 1)}.get(kind, 0)
            yield self._row(s, "cart", ts, e, number=s["cart"])
        if self.rage_types is None or kind in self.rage_types:
            s["rage"], fired = self.rage(s["rage"], (ts, None, e["x"], e["y"]))
            for f in fired:
                yield self._row(s, "rage_click", ts, e, number=f[-1])
        if kind == "section_enter":
            section = json.dumps(e["section"])
            s["sections"][section] = n = s["sections"].get(section, 0) + 1
            if n > 1:
                yield self._row(s, "revisit", ts, e, name=e["section"], number=n)
        if kind in ("option_select", "option_change"):
            yield from self._option(s, e)
        s["events"] += 1
        s["last"], s["exit"] = ts, e["pathname"]
        s["active"] = s["active"] or kind not in PASSIVE
        if e["scroll_y"] is not None:
            s["scroll"] = e["scroll_y"]

    def _page(self, s: dict, e: dict) -> Iterator[dict]:
        ts, kind = e["timestamp"], e["event_type"]
        if kind == "navigation":
            if s["events"]:
                yield self._left(s, ts)
            s["pages"] += 1
        if kind == "navigation" or not s["events"]:
            s["page"], s["page_ts"] = e["pathname"], ts
        if kind in ("navigation", "session_start"):
            s["visit"], s["entered"], s["clicked"] = s["visit"] + 1, ts, False
        if kind == "click" and s.get("entered") is not None and not s["clicked"]:
            s["clicked"] = True
            yield self._row(s, "first_click", ts, e, number=s["visit"], duration_ms=ts - s["entered"])

    def _left(self, s: dict, at: int) -> dict:
        return self._row(s, "page", at, name=s["page"], number=s["pages"], duration_ms=at - s["page_ts"])

    def _silence(self, s: dict, e: dict) -> Iterator[dict]:
        ts, kind = e["timestamp"], e["event_type"]
        if kind == "inactivity":
            return
        since = s.get("heard")
        if since is not None and ts >= since + self.idle_ms:
            yield self._row(s, "inactivity", since + self.idle_ms, e, duration_ms=ts - since - self.idle_ms)
        if kind != "session_end":
            s["heard"], s["idle"] = ts, False

    def _option(self, s: dict, e: dict) -> Iterator[dict]:
        name = json.dumps(e["option_name"])
        before, n = s["options"].get(name, (None, 0))
        if before is not None and e["option_value"] is not None and before != e["option_value"]:
            n += 1
            yield self._row(s, "option", e["timestamp"], e, name=e["option_name"], number=n)
        s["options"][name] = (e["option_value"], n)

    def deadline(self, s: dict) -> int | None:
        if "start" not in s:
            return None
        over = s["last"] + self.ttl_ms
        return min(over, s["heard"] + self.idle_ms) if s.get("heard") is not None and not s["idle"] else over

    def expire(self, s: dict, at: int) -> Iterator[dict]:
        over = at >= s["last"] + self.ttl_ms
        if s.get("heard") is not None and not s["idle"] and at >= s["heard"] + self.idle_ms:
            s["idle"] = True
            yield self._row(s, "idle", s["heard"] + self.idle_ms)
            return
        if over:
            yield self._left(s, s["last"])
            yield self._row(
                s, "session_end", s["last"], name=s["exit"], number=s["events"], duration_ms=s["last"] - s["page_ts"], depth=s["pages"],
                bounce=s["pages"] <= 1 and not s["active"], scroll_y=s.get("scroll"), source=s["source"], exit_reason="timeout",
            )
            s.clear()


def live_sessions(events: DataFrame, user: str = "user_id", time: str = "event_time", delay: str = "10 minutes", **rules) -> DataFrame:
    """Rows of ``LIVE`` for a stream of ``live_rows``."""
    kind = events.schema["event_id"].dataType.simpleString()
    return walked(events, Session(**rules), LIVE.format(id=kind), user, time, delay)


# --- motion ---------------------------------------------------------------------------------------


class Motion(Walk):
    """Distance and flips of direction per window and session, from raw positions: the last position and direction outlive a window."""

    def __init__(self, window_ms: int, ttl_ms: int):
        self.window_ms, self.ttl_ms = window_ms, ttl_ms

    def event(self, s: dict, e: dict) -> Iterator[dict]:
        ts, x, y = e["timestamp"], e["x"], e["y"]
        start = ts - ts % self.window_ms
        if s.get("window") != start:
            s.update(window=start, distance=0.0, flips=0)
        towards = None
        if None not in (x, y, s.get("x"), s.get("y")):
            dx, dy = x - s["x"], y - s["y"]
            s["distance"] += math.sqrt(dx * dx + dy * dy)
            towards = [(dx > 0) - (dx < 0), (dy > 0) - (dy < 0)]
            s["flips"] += s.get("towards") not in (None, towards)
        s.update(x=x, y=y, towards=towards, last=ts)
        return iter(())

    def deadline(self, s: dict) -> int | None:
        if "last" not in s:
            return None
        return s["last"] + self.ttl_ms if s["window"] is None else s["window"] + self.window_ms

    def expire(self, s: dict, at: int) -> Iterator[dict]:
        if s["window"] is None:
            s.clear()
            return
        distance = math.floor(s["distance"] + 0.5)
        if distance > 0:
            yield {"window_start": s["window"], "distance_px": distance, "jitter_count": s["flips"]}
        s["window"] = None


def live_motion(
    positions: DataFrame, user: str = "user_id", time: str = "event_time", delay: str = "10 seconds", window_ms: int = 2_000,
    ttl_ms: int = TTL_MS,
) -> DataFrame:
    """(user, window_start, distance_px, jitter_count) from a stream of (user, time, timestamp, event_id, x, y); ``ttl_ms`` of silence
    (more than a window) ends a session, and the next position starts anew."""
    return walked(positions, Motion(window_ms, ttl_ms), "window_start long, distance_px long, jitter_count long", user, time, delay)
