"""Ordered rules as data: the first rule that matches names the value.

A rule set is a list of ``(value, words)``: the words that name the value, as regular expressions over a lower-cased
column, or one such expression. Sites swap rule sets, the operators stay the same.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, "str | Sequence[str]"]]


def pattern_of(words: str | Sequence[str]) -> str:
    return words if isinstance(words, str) else "|".join(words)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def plain_words(words: str | Sequence[str]) -> list[str]:
    """The words of a list without expressions in them, fewest that say the same; none where there is an expression."""
    if isinstance(words, str) or any(re.search(r"[\\^$.|?*+()\[\]{}]", w) or not w for w in words):
        return []
    return [w for i, w in enumerate(words) if w not in words[:i] and not any(o != w and o in w for o in words)]


def _found_sql(subject: str, words: str | Sequence[str]) -> str:
    plain = plain_words(words)
    return " OR ".join(f"contains({subject}, {quoted(w)})" for w in plain) or f"{subject} RLIKE {quoted(pattern_of(words))}"


def first_match(subject: Column | str, rules: Rules, default: Column | str | None = None) -> Column:
    """Value of the first rule whose pattern occurs in ``subject``.

    A column named by text becomes one SQL expression; that spares a call per rule while planning. Lists of plain words are
    looked up as they are, which takes a fraction of a regular expression's time.
    """
    if isinstance(subject, str):
        fallback = "NULL" if default is None else quoted(default) if isinstance(default, str) else None
        whens = " ".join(f"WHEN {_found_sql(subject, words)} THEN {quoted(value)}" for value, words in rules)
        if fallback is not None:
            return F.expr(f"CASE {whens} ELSE {fallback} END")
        return F.coalesce(F.expr(f"CASE {whens} END"), default)
    out = None
    for value, words in rules:
        plain = plain_words(words)
        hit = reduce(or_, map(subject.contains, plain)) if plain else subject.rlike(pattern_of(words))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def first_in_text(text: Column, lower: Column, rules: Rules, default: str | None = None) -> Column:
    """``first_match`` for long texts: words are looked up as they are, which takes a fraction of a regular expression's time.

    ``lower`` is the lower-case text, best a column of its own. Rules with expressions in them, or that ignore case (``(?i)``), are matched
    as expressions where the plain parts of a word occur; words that contain another word of their rule add nothing.
    """
    out = None
    for value, words in rules:
        hit = _occurs(text, lower, words)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def _occurs(text: Column, lower: Column, words: str | Sequence[str]) -> Column:
    whole = pattern_of(words)
    names = [words] if isinstance(words, str) else list(words)
    folded = names[0].startswith("(?i)")
    names = [names[0].removeprefix("(?i)"), *names[1:]] if folded else names
    parts = [n.split(".?") for n in names]
    if any(re.search(r"[\\^$.|?*+()\[\]{}]", p) or not p for ps in parts for p in ps):
        return text.rlike(whole)
    where = lower if folded else text
    parts = [[p.lower() for p in ps] if folded else ps for ps in parts]
    alone = [ps[0] for ps in parts if len(ps) == 1]
    needed = [ps for i, ps in enumerate(parts) if not any(w in p for p in ps for w in alone if ps != [w]) and ps not in parts[:i]]
    found = reduce(or_, (reduce(and_, (where.contains(p) for p in ps)) for ps in needed))
    return found & text.rlike(whole) if folded or any(len(ps) > 1 for ps in needed) else found


def lookup(key: Column | str, table: Mapping[str, str]) -> Column:
    """Value of a small fixed table, null when absent."""
    pairs = ", ".join(map(quoted, chain.from_iterable(table.items())))
    return F.expr(f"map({pairs})[{key}]") if isinstance(key, str) else F.expr(f"map({pairs})")[key]


def lowered(value: Column) -> Column:
    """Trimmed lower-case text, '' for null."""
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))
