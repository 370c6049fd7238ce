"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.session import cut

#: Python sees texts in batches; very long texts must not meet in one batch by the thousand.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20

#: ASCII white space, the only separators of words here.
SPACES = " \t\n\v\f\r"
#: The same for regular expressions of Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


class Recent:
    """What a Python worker remembers, in two generations: entries that are still in use move to the new one, the rest goes."""

    def __init__(self, most: int = 150_000):
        self.most, self.now, self.before = most, {}, {}

    def missing(self, wanted: set) -> set:
        """Bring the wanted entries to ``now``; those that are not known at all come back."""
        if len(self.now) > self.most:
            self.before, self.now = self.now, {}
        # the small set asks the large ones, never the other way round
        now, before, new = self.now, self.before, set()
        for k in wanted:
            if k not in now:
                known = before.get(k)
                if known is None:
                    new.add(k)
                else:
                    now[k] = known
        return new


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def complete_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream that is sorted by its first ``keys`` columns into tables of whole groups, with the groups' borders.

    Holds one batch and the group that is not over yet.
    """

    def borders(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for i in range(keys):
            k = table.column(i).to_numpy()
            change |= k[1:] != k[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        at = borders(held)
        if len(at) > 2:
            yield held.slice(0, at[-2]).combine_chunks(), at[:-1]
            held = held.slice(at[-2])
    if held is not None:
        yield held.combine_chunks(), borders(held)


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` points is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of the edges is connected to; roots themselves are left out.

    Alternating large and small stars: every round hangs neighbours under the smallest one, in a few rounds whatever the
    size of a component. Each round is a written table, so a lost executor repeats one round at most.
    """

    def star(e: DataFrame, both_ways: bool) -> DataFrame:
        # hang every neighbour (the larger ones, or the smaller ones and the node itself) under the smallest
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else e
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        met = near.join(low, "u")
        if both_ways:
            hung = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            hung = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return hung.where(F.col("u") != F.col("v")).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()

    edges = edges.where(F.col(a) != F.col(b))
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = mark(now)
    while before[0]:
        now = cut(star(star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
