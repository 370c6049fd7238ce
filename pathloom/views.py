"""Operators as views, for users who write SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from pathloom.operators import behaviour, reports, rollups, sequences, sessions, vocab

#: View name to what it shows of sessionized events; tables are read when a query asks for them.
VIEWS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {
    "session_rollup": lambda e, keys: rollups.session_rollup(e, keys),
    "event_tokens": lambda e, keys: sequences.semantic_tokens(e, keys),
    "session_sequences": lambda e, keys: sequences.semantic_sequences(e, keys),
    "session_stages": lambda e, keys: reports.furthest_stage(sequences.semantic_sequences(e, keys), keys),
    "vocabulary": lambda e, keys: vocab.build_vocab(sequences.semantic_sequences(e, keys)),
    "cart_states": lambda e, keys: behaviour.cart_state(e, keys),
    "page_visits": lambda e, keys: behaviour.page_dwell(e, keys),
    "inactivity": lambda e, keys: behaviour.inactivity_spans(e, keys),
    "exit_records": lambda e, keys: behaviour.exit_records(e, keys),
}


def register_views(
    events: DataFrame, keys: Sequence[str] = sessions.SESSION, prefix: str = "", names: Sequence[str] | None = None,
    more: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] | None = None,
) -> list[str]:
    """Make operators over sessionized ``events`` (payload as ``p``) readable by ``spark.sql``: the names of the views.

    ``events`` itself is ``events``. ``names`` chooses views, ``more`` adds the caller's own operators or replaces given ones; each
    view is computed by the queries that read it.
    """
    known = {**VIEWS, **(more or {})}
    chosen = list(known) if names is None else list(names)
    events.createOrReplaceTempView(f"{prefix}events")
    for name in chosen:
        known[name](events, list(keys)).createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{n}" for n in ["events", *chosen]]
