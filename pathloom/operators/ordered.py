"""Ordered computations per key that hold when one key owns a large part of all rows.

Most operators need "the previous row of this session", "the last known page" or "how many so
far". A plain window does that, but puts a whole key into one task. So the rows per key are
counted first (one column, combined map-side):

* no key above ``pathloom.hot.rows``: one plain window per key, one shuffle;
* otherwise the few hot keys are cut into key-and-order ranges of bounded size. Every range is
  evaluated on its own, a small table with one row per range carries totals and last values from
  range to range, and the two are joined. The results are the same, no task holds a whole key.

Both ways run the same operator code, see ``ordered``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.session import cut, hot_rows

CHUNK = "__chunk"
SEQUENCE = "__sequence"
EVENT_ORDER = ["timestamp", "event_id"]


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column


def lag(value: Column) -> Step:
    """Value of the previous row, null included."""
    return Step("lag", value)


def lead(value: Column) -> Step:
    """Value of the next row, null included."""
    return Step("lead", value)


def known(value: Column) -> Step:
    """Last non-null value up to and including this row."""
    return Step("known", value)


def prev_known(value: Column) -> Step:
    """Last non-null value of the earlier rows."""
    return Step("prev_known", value)


def next_known(value: Column) -> Step:
    """First non-null value of the later rows."""
    return Step("next_known", value)


def running_sum(value: Column) -> Step:
    return Step("sum", value)


def running_min(value: Column) -> Step:
    return Step("min", value)


def running_max(value: Column) -> Step:
    return Step("max", value)


class Keyed:
    """Rows grouped by ``keys`` and ordered by ``order``, whose last column must make rows distinct."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunked: bool = False):
        self.df, self.keys, self.order, self.chunked = df, list(keys), list(order), chunked

    def _with(self, df: DataFrame) -> Keyed:
        return Keyed(df, self.keys, self.order, self.chunked)

    def where(self, condition: Column) -> Keyed:
        return self._with(self.df.where(condition))

    def cols(self, **cols: Column) -> Keyed:
        return self._with(self.df.withColumns(cols))

    def add(self, by: Sequence[str] = (), **steps: Step) -> Keyed:
        """Add one column per step; ``by`` splits the keys further."""
        part = [*self.keys, *by]
        if not self.chunked:
            return self._with(self.df.withColumns({n: _within(s, part, self.order) for n, s in steps.items()}))
        return self._with(self._add_chunked(part, steps))

    def _add_chunked(self, part: list[str], steps: dict[str, Step]) -> DataFrame:
        rank = F.struct(*self.order)
        earlier = Window.partitionBy(*part).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*part).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)

        totals = self.df.groupBy(*part, CHUNK).agg(
            *(_summary(s, rank).alias(f"__t_{n}") for n, s in steps.items())
        )
        carried = totals.select(
            *(F.col(c).alias(f"__k_{c}") for c in [*part, CHUNK]),
            *(_carry(s, F.col(f"__t_{n}"), earlier, later).alias(f"__c_{n}") for n, s in steps.items()),
        )
        # null-safe: a split column such as the section may be null
        same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*part, CHUNK]]
        local = self.df.withColumns({f"__l_{n}": _local(s, [*part, CHUNK], self.order) for n, s in steps.items()})
        merged = {n: _merge(s, F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n, s in steps.items()}
        drop = [f"__k_{c}" for c in [*part, CHUNK]]
        drop += [f"__{side}_{n}" for n in steps for side in "lc"]
        return cut(local.join(carried, on=same, how="left").withColumns(merged).drop(*drop))


def _boxed(value: Column) -> Column:
    return F.struct(value.alias("v"))


def _known_box(value: Column) -> Column:
    return F.when(value.isNotNull(), _boxed(value))


def _within(s: Step, part: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    match s.kind:
        case "lag":
            return F.lag(s.value).over(w)
        case "lead":
            return F.lead(s.value).over(w)
        case "known":
            return F.last(s.value, ignorenulls=True).over(upto)
        case "prev_known":
            return F.last(s.value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        case "next_known":
            # walked backwards: a frame that reaches to the end is read again for every row
            back = Window.partitionBy(*part).orderBy(*(F.desc(c) for c in order))
            return F.last(s.value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
        case "sum":
            return F.sum(s.value).over(upto)
        case "min":
            return F.min(s.value).over(upto)
        case "max":
            return F.max(s.value).over(upto)
    raise ValueError(s.kind)


def _local(s: Step, part: list[str], order: list[str]) -> Column:
    if s.kind in ("lag", "lead"):
        s = Step(s.kind, _boxed(s.value))
    elif s.kind in ("known", "prev_known", "next_known"):
        s = Step(s.kind, _known_box(s.value))
    return _within(s, part, order)


def _summary(s: Step, rank: Column) -> Column:
    known_rank = F.when(s.value.isNotNull(), rank)
    match s.kind:
        case "lag":
            return F.max_by(_boxed(s.value), rank)
        case "lead":
            return F.min_by(_boxed(s.value), rank)
        case "known" | "prev_known":
            return F.max_by(_boxed(s.value), known_rank)
        case "next_known":
            return F.min_by(_boxed(s.value), known_rank)
        case "sum":
            return F.sum(s.value)
        case "min":
            return F.min(s.value)
        case "max":
            return F.max(s.value)
    raise ValueError(s.kind)


def _carry(s: Step, total: Column, earlier, later) -> Column:
    match s.kind:
        case "lag" | "known" | "prev_known":
            return F.last(total, ignorenulls=True).over(earlier)
        case "lead" | "next_known":
            return F.first(total, ignorenulls=True).over(later)
        case "sum":
            return F.sum(total).over(earlier)
        case "min":
            return F.min(total).over(earlier)
        case "max":
            return F.max(total).over(earlier)
    raise ValueError(s.kind)


def _merge(s: Step, local: Column, carried: Column) -> Column:
    match s.kind:
        case "sum":
            return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(local + carried)
        case "min":
            return F.least(local, carried)
        case "max":
            return F.greatest(local, carried)
    return F.coalesce(local, carried)["v"]


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more rows than one task may order, or None. At most (all rows / bound) of them."""
    bound = hot_rows(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bound)
    return None if counts.isEmpty() else cut(counts)


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """Cut rows into ranges of (keys, order) that never exceed about one task's bound.

    Written out, because the range borders come from a sample and must not change afterwards.
    """
    n = max(2, 2 * math.ceil(rows / hot_rows(df.sparkSession)))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id()))


def sequenced(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Events of one time follow the client's own numbering, where there is one, before their id.

    A number that is missing or no number counts as 0.
    """
    if list(order) != EVENT_ORDER or "event_seq" not in df.columns:
        return df, list(order)
    number = F.coalesce(F.col("event_seq").cast("string").try_cast("double"), F.lit(0.0))
    return df.withColumn(SEQUENCE, number), [order[0], SEQUENCE, order[1]]


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[Keyed], DataFrame],
    bounded: bool = False,
) -> DataFrame:
    """Run ``build`` over the rows; ``bounded`` says the caller has already checked the keys."""
    df, order = sequenced(df, order)
    hot = None if bounded else hot_keys(df, keys)
    if hot is None:
        return build(Keyed(df, keys, order)).drop(SEQUENCE)
    names = hot.select(*keys)
    same = [df[k].eqNullSafe(names[k]) for k in keys]
    rows = hot.agg(F.sum("__n")).first()[0]
    chunks = ranges(df.join(names, on=same, how="left_semi"), keys, order, rows)
    few = build(Keyed(df.join(names, on=same, how="left_anti"), keys, order))
    many = build(Keyed(chunks, keys, order, chunked=True))
    return few.unionByName(many.drop(CHUNK)).drop(SEQUENCE)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows 1, 2, … by ``order``, in ranges when the table exceeds one task's bound."""
    return ordered(
        df.withColumn("__all", F.lit(0)),
        ["__all"],
        order,
        lambda k: k.add(**{name: running_sum(F.lit(1).cast("long"))}).df,
    ).drop("__all")


# --- folds: the next step depends on the previous *output* ---------------------------------------

Fold = Callable[[dict, tuple], tuple[dict, list[tuple]]]


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    step: Fold,
    out: T.StructType,
    bounded: bool = False,
) -> DataFrame:
    """Walk every key in order with a small state; ``step(state, row) -> (state, output rows)``.

    ``row`` holds ``values``. Rows stream through the task, a key is never collected. Hot keys are cut
    into ranges; each range starts from the state its predecessor ended in, and only ranges whose
    start state changed are walked again, until none changes.
    """
    df, sorted_by = sequenced(df, order)
    df = df.select(*keys, *sorted_by, *(v for v in values if v not in [*keys, *sorted_by]))
    order = sorted_by
    # keys walk as text: a null among numbers would turn them all into floats
    own_type = {k: df.schema[k].dataType for k in keys}
    df = df.withColumns({k: F.col(k).cast("string") for k in keys})
    key_type = [df.schema[k] for k in keys]
    result = T.StructType([*key_type, *out.fields])

    def typed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({k: F.col(k).cast(t) for k, t in own_type.items()})

    hot = None if bounded else hot_keys(df, keys)
    if hot is None:
        rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
        return typed(rows.mapInPandas(_walker(keys, values, step, result.names), result))

    names = hot.select(*keys)
    same = [df[k].eqNullSafe(names[k]) for k in keys]
    cold = df.join(names, on=same, how="left_anti").repartition(*keys).sortWithinPartitions(*keys, *order)
    chunks = ranges(
        df.join(names, on=same, how="left_semi"), keys, order, hot.agg(F.sum("__n")).first()[0]
    )
    group = [*keys, CHUNK]
    state_type = T.StructType([*key_type, chunks.schema[CHUNK], T.StructField("__exit", T.StringType())])
    before = Window.partitionBy(*keys).orderBy(CHUNK)
    entry = chunks.select(*group).distinct().withColumn("__entry", F.lit(None).cast("string"))
    exits, todo = None, cut(entry)
    while True:
        walked = _started(chunks, todo, group, order).mapInPandas(
            _walker(keys, values, step, state_type.names, (CHUNK,), states_only=True), state_type
        )
        if exits is not None:
            walked = exits.join(todo.select(*group), on=group, how="left_anti").unionByName(walked)
        exits = cut(walked)
        nxt = exits.select(*group, F.lag("__exit").over(before).alias("__entry"))
        old = entry.select(*group, F.col("__entry").alias("__old"))
        todo = cut(
            nxt.join(old, on=group).where(~F.col("__entry").eqNullSafe(F.col("__old"))).drop("__old")
        )
        entry = cut(nxt)
        if todo.isEmpty():
            break
    hot_out = _started(chunks, entry, group, order).mapInPandas(
        _walker(keys, values, step, result.names, (CHUNK,)), result
    )
    return typed(cold.mapInPandas(_walker(keys, values, step, result.names), result).unionByName(hot_out))


def _started(chunks: DataFrame, entry: DataFrame, group: list[str], order: Sequence[str]) -> DataFrame:
    """Rows of the ranges in ``entry`` with their start state, sorted within one task per range."""
    return chunks.join(entry, on=group).repartition(*group).sortWithinPartitions(*group, *order)


def _walker(keys, values, step, names: list[str], extra: tuple = (), states_only: bool = False):
    group, width = [*keys, *extra], len(keys)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for pdf in batches:
            rows = []
            entries = pdf["__entry"] if "__entry" in pdf else [None] * len(pdf)
            for key, row, entry in zip(
                zip(*(pdf[c] for c in group)), zip(*(pdf[c] for c in values)), entries
            ):
                if key != current:
                    if states_only and current is not None:
                        rows.append((*current, json.dumps(state, sort_keys=True)))
                    current, state = key, json.loads(entry) if entry else {}
                state, emitted = step(state, row)
                if not states_only:
                    rows.extend((*key[:width], *e) for e in emitted)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if states_only and current is not None:
            yield pd.DataFrame([(*current, json.dumps(state, sort_keys=True))], columns=names)

    return walk
