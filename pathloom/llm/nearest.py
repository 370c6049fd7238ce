"""Approximate nearest neighbours (9): a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and every vector is filed under a leaf. A query walks the tree with a priority
queue: the branch with the largest bound on the inner product is opened next, so it meets leaves in order of
promise. How many leaves a query opens is calibrated: the number widens until a set of queries, answered exactly
for comparison, reaches the wanted recall.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.session import cut

#: Rows that the tree is fitted on, about; at most twice as many. Chosen by the hash of their id. The tree's size is bounded by it.
SAMPLE_ROWS = 20_000
BRANCHES, LEAF_ROWS = 8, 64
#: Rows of a leaf, and queries, that meet in one task.
BLOCK = 4_096
#: Queries that the recall is measured on, about (at most twice as many), and the recall they must reach.
CALIBRATION, RECALL = 200, 0.95
#: Share of a node's radius that counts in its promise: in many dimensions little of it points the query's way.
SPREAD = 0.25


@dataclass
class Tree:
    """Nodes in arrays: centre, radius of the sample below, children; a leaf has a number instead of children."""

    centre: np.ndarray
    radius: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    leaves: int

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector: the nearest child at each level."""
        at = np.zeros(len(vectors), np.int64)
        while True:
            moving = np.flatnonzero(self.leaf[at] < 0)
            if not len(moving):
                return self.leaf[at]
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                below = np.array(self.children[node])
                c = self.centre[below]
                at[rows] = below[((c * c).sum(1) - 2 * vectors[rows] @ c.T).argmin(1)]

    def visits(self, query: np.ndarray, n: int) -> list[int]:
        """The first ``n`` leaves in best-bin-first order.

        A node's promise is the inner product with its centre plus what its radius may add.
        """
        near = self.centre @ query + math.sqrt(float(query @ query)) * self.radius * SPREAD
        queue, out = [(-near[0], 0)], []
        while queue and len(out) < n:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(queue, (-near[child], child))
        return out


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> Tree:
    """Split by k-means until a node holds ``leaf_rows`` rows at most; equal rows stay together in one leaf."""
    r = np.random.default_rng(seed)
    centre, radius, children, leaf, leaves = [], [], [], [], 0
    todo = [(sample, None)]
    while todo:
        rows, parent = todo.pop()
        node = len(centre)
        mean = rows.mean(0)
        centre.append(mean)
        radius.append(math.sqrt(((rows - mean) ** 2).sum(1).mean()))
        children.append([])
        leaf.append(-1)
        if parent is not None:
            children[parent].append(node)
        parts = split(rows, branches, r) if len(rows) > leaf_rows else []
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
        else:
            todo += [(p, node) for p in parts]
    return Tree(np.array(centre), np.array(radius), children, np.array(leaf), leaves)


def split(rows: np.ndarray, k: int, r: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    """Lloyd's k-means from distinct rows."""
    c = np.unique(rows[r.permutation(len(rows))[: 4 * k]], axis=0)
    c = c[r.permutation(len(c))[:k]]
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * rows @ c.T).argmin(1)
        c = np.array([rows[at == i].mean(0) for i in np.unique(at)])
    at = ((c * c).sum(1) - 2 * rows @ c.T).argmin(1)
    return [rows[at == i] for i in np.unique(at)]


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, ids, scores) of each query's ``k`` best rows; ties to the smaller id, the query's own id left out.

    A matrix product finds who may be among them, one fixed sum per pair gives the score, so equal vectors score equal.
    """
    for start in range(0, len(queries), 512):
        q = queries[start : start + 512]
        near = q @ rows.T
        near[query_ids[start : start + 512][:, None] == ids[None, :]] = -np.inf
        kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -np.inf)
        slack = 1e-9 * (1 + np.abs(near).max(axis=1, initial=0, where=np.isfinite(near)))
        for i in range(len(q)):
            may = np.flatnonzero((near[i] >= kth[i] - slack[i]) & np.isfinite(near[i]))
            score = (rows[may] * q[i]).sum(1)
            order = np.lexsort((ids[may], -score))[:k]
            if len(order):
                yield query_ids[start + i], ids[may][order], score[order]


RESULT = "query_id long, found array<struct<vec_id:long,score:double>>"


def _answers(k: int):
    def answer(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series([], "int64"), "found": pd.Series([], object)})
        out = best(matrix(left["v"]), left["id"].to_numpy(), matrix(right["v"]), right["id"].to_numpy(), k)
        rows = [(q, [{"vec_id": int(i), "score": float(s)} for i, s in zip(ids, score)]) for q, ids, score in out]
        return pd.DataFrame(rows, columns=["query_id", "found"])

    return answer


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best of its lists, with rank; every task cuts to ``k`` before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("f.score"), "f.vec_id")
    ranked = found.select("query_id", F.explode("found").alias("f")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "f.*")


def _share(column: str, salt: int, rows: int, of: int) -> Column:
    """About ``rows`` of ``of`` rows, chosen by the hash of a column."""
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) < math.ceil(min(1.0, rows / max(of, 1)) * (1 << 30))


def _searched(queries: DataFrame, rows: DataFrame, k: int, blocks: DataFrame) -> DataFrame:
    """Every query's best rows of the leaves it visits. ``queries``: id, v, leaf; ``rows``: id, v, leaf, block; ``blocks``: leaf, blocks.

    A task gets one block of a leaf and one block of the queries that visit it.
    """
    met = queries.join(blocks, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    share = met.groupBy("leaf", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shares"))
    met = met.join(share, ["leaf", "block"]).withColumn("share", F.pmod(F.xxhash64("id"), "shares"))
    held = rows.join(share, ["leaf", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    key = ["leaf", "block", "share"]
    return met.select(*key, "id", "v").groupBy(*key).cogroup(held.select(*key, "id", "v").groupBy(*key)).applyInPandas(_answers(k), RESULT)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    recall: float = RECALL,
    sample_rows: int = SAMPLE_ROWS,
    calibration: int = CALIBRATION,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Each query's ``k`` rows of largest inner product found: (query_id, rank, vec_id, score, leaves).

    Vectors that are null, zero or hold null or non-finite components take no part, neither do null ids. Candidates are all
    rows but those with the query's own id; ties go to the smaller id. Repeated query ids are answered once, a repeated row is a candidate as
    often as it occurs. Fewer candidates than ``k``: all of them. Empty tables give no rows. Vectors must have one length.
    ``leaves`` says how many leaves each query opened at least; one whose leaves hold too few rows goes on until they hold ``k``. Only the tree and the calibration queries pass through the driver,
    both bounded by parameters; hot leaves are cut into blocks.
    """
    spark = vectors.sparkSession
    shape = "id long, v array<double>, leaf int"

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return rows.where(usable(F.col("v")) & F.col("id").isNotNull())

    every = clean(vectors)
    chosen = every.where(_share("id", 1, sample_rows, every.count())).orderBy(F.xxhash64("id"), "id", "v").limit(2 * sample_rows).toPandas()
    # the tree depends on the order of its rows, which must not depend on how the table is split
    chosen = chosen.assign(v=chosen["v"].map(tuple)).sort_values(["id", "v"])
    asked = clean(queries).groupBy("id").agg(F.min("v").alias("v"))
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, leaves int")
    tree = fit_tree(matrix(chosen["v"]))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.file(matrix(b["v"])).astype("int32"))

    filed = cut(every.mapInPandas(file, shape))
    blocks = filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = filed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    blocks = cut(blocks)
    held = np.zeros(tree.leaves, np.int64)  # one number per leaf of the bounded tree
    for leaf, n in filed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        held[leaf] = n

    def enough(v: np.ndarray, own: int, n: int) -> list[int]:
        """The first ``n`` leaves, and more until they hold ``k`` rows that may be candidates."""
        leaves = list(tree.visits(v, n))
        if held[leaves].sum() < k + own and n < tree.leaves:
            order = list(tree.visits(v, tree.leaves))
            n += int(np.searchsorted(np.cumsum(held[order])[n:], k + own)) + 1
            leaves = order[:n]
        return leaves

    times = filed.join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    asked = cut(asked.join(times, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))))

    def visiting(n: int):
        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), 256):
                    some = b.iloc[i : i + 256]
                    leaves = [enough(np.asarray(v, float), int(own), n) for v, own in zip(some["v"], some["own"])]
                    some = some.drop(columns="own")
                    yield some.assign(leaf=leaves).explode("leaf").astype({"leaf": "int32"})

        return visit

    opened = _calibrated(asked, filed, tree, k, recall, calibration)
    wide = asked.mapInPandas(visiting(opened), shape)
    return _top(_searched(wide, rows, k, blocks), k).withColumn("leaves", F.lit(opened))


def _calibrated(asked: DataFrame, filed: DataFrame, tree: Tree, k: int, recall: float, calibration: int) -> int:
    """Leaves to open: the fewest, in steps of a quarter, with which the calibration queries find the wanted share of their true neighbours.

    The true neighbours come from all rows: every task scores its own against the few queries and keeps ``k`` each.
    """
    held = asked.where(_share("id", 7, calibration, asked.count())).limit(2 * calibration).toPandas()
    if not len(held):
        return 1
    q, ids = matrix(held["v"]), held["id"].to_numpy()
    kind = "query_id long, found array<struct<vec_id:long,score:double,leaf:int>>"

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            leaf = dict(zip(b["id"], b["leaf"]))
            out = best(q, ids, matrix(b["v"]), b["id"].to_numpy(), k)
            yield pd.DataFrame(
                [(a, [{"vec_id": int(i), "score": float(s), "leaf": int(leaf[i])} for i, s in zip(x, y)]) for a, x, y in out],
                columns=["query_id", "found"],
            )

    true = _top(filed.mapInPandas(exact, kind), k).toPandas().groupby("query_id")["leaf"].apply(list).to_dict()
    rank = []
    for i, v in zip(ids, q):
        order = {leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves))}
        rank += [order[leaf] for leaf in true.get(i, [])]
    rank = np.array(rank)
    n = 1
    while n < tree.leaves and len(rank) and (rank < n).mean() < recall:
        n = min(tree.leaves, max(n + 1, n * 5 // 4))
    return n
