"""Sharding (5): a reproducible shuffle by a Feistel permutation of global row numbers.

Rows are numbered 0 … N-1 by (id, CRC, size). The permutation works on an a × b grid that holds N numbers or a few
more: rounds add a keyed function of one coordinate to the other. A number that leaves 0 … N-1 walks on along its
cycle until it comes back, so the result is a permutation of exactly 0 … N-1. A row's place p gives shard ``p % shards``
and slot ``p // shards``; both follow from the row number alone, and back.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut

ROUNDS = 6
PRIME = 2_147_483_647
FACTOR = 1_103_515_245


def grid(rows: int) -> tuple[int, int]:
    """a × b at least ``rows``, as near to it as sides close to its root allow."""
    root = max(1, math.isqrt(rows))
    return min(((a, -(-rows // a)) for a in range(root, root + 64)), key=lambda s: (s[0] * s[1], s[0]))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    key, out = seed % PRIME, []
    for _ in range(rounds):
        key = (key * 48_271 + 12_820_163) % PRIME
        out.append(key)
    return out


def _mix(value: int, key: int) -> int:
    t = (value + key) % PRIME
    return (t * t % PRIME * FACTOR + key) % PRIME


def place(row: int, rows: int, seed: int = 1) -> int:
    """Where a row number goes, for readers that want one row without Spark."""
    a, b = grid(rows)
    while True:
        left, right = divmod(row, b)
        for i, key in enumerate(round_keys(seed)):
            if i % 2:
                right = (right + _mix(left, key)) % b
            else:
                left = (left + _mix(right, key)) % a
        row = left * b + right
        if row < rows:
            return row


def row_at(position: int, rows: int, seed: int = 1) -> int:
    """The row number that goes to a place; the inverse of ``place``."""
    a, b = grid(rows)
    keys = list(enumerate(round_keys(seed)))
    while True:
        left, right = divmod(position, b)
        for i, key in reversed(keys):
            if i % 2:
                right = (right - _mix(left, key)) % b
            else:
                left = (left - _mix(right, key)) % a
        position = left * b + right
        if position < rows:
            return position


def _mixed(value: Column, key: Column) -> Column:
    t = (value + key) % PRIME
    return ((t * t) % PRIME * FACTOR + key) % PRIME


def _div(value: Column, by: Column) -> Column:
    return F.call_function("div", value, by).cast("long")


def _permuted(number: Column, a: int, b: int, keys: list[int]) -> Column:
    def step(s: Column, k: Column) -> Column:
        on_left = F.struct(((s["l"] + _mixed(s["r"], k["key"])) % a).alias("l"), s["r"].alias("r"))
        on_right = F.struct(s["l"].alias("l"), ((s["r"] + _mixed(s["l"], k["key"])) % b).alias("r"))
        return F.when(k["odd"], on_right).otherwise(on_left)

    side = F.lit(b).cast("long")
    start = F.struct(_div(number, side).alias("l"), (number % side).alias("r"))
    rounds = F.array(*(F.struct(F.lit(k).cast("long").alias("key"), F.lit(bool(i % 2)).alias("odd")) for i, k in enumerate(keys)))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * side + s["r"])


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Global row numbers 0 … N-1 in ``order``, and N. One range shuffle; only counts per partition reach the driver.

    Equal rows may lie in any partition, as a running number of the input breaks their ties; numbers of equal rows are
    interchangeable.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie")
    # partition in the upper 31 bits, place in the partition in the lower 33
    held = cut(sorted_.drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    counts = dict(held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.zeros(max(counts, default=0) + 1, "int64")
    total = 0
    for p in range(len(before)):
        before[p] = total
        total += counts.get(p, 0)
    first = F.element_at(F.lit(before), part + 1)
    return held.withColumn(name, first + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at"), total


def assign(
    docs: DataFrame, shards: int = 40, seed: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shard and slot of every row: (id, size, text_crc32, row, shard, slot).

    Sizes of shards differ by one row at most. A null text has size 16 and the CRC of nothing. Null ids come first,
    repeated rows get a place each, other columns play no part; an empty table gives no rows.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(doc_id), (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, n = numbered(narrow, [doc_id, "text_crc32", "size"], "row")
    a, b = grid(max(n, 1))
    keys = round_keys(seed)
    outside = a * b - n
    at = rows.withColumn("__p", _permuted(F.col("row"), a, b, keys))
    if n and outside:
        # a walk meets every number outside at most once, so it is back after that many steps
        steps = F.sequence(F.lit(1), F.lit(outside))
        walked = F.aggregate(steps, F.col("__p"), lambda p, _: F.when(p < n, p).otherwise(_permuted(p, a, b, keys)))
        at = at.withColumn("__p", F.when(F.col("__p") < n, F.col("__p")).otherwise(walked))
    return at.select(
        doc_id, "size", "text_crc32", "row",
        (F.col("__p") % shards).cast("int").alias("shard"),
        _div(F.col("__p"), F.lit(shards)).alias("slot"),
    )
