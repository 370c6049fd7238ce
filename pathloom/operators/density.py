"""Clusters by local density: crowded cells of a grid grow together, what lies apart is noise.

Points are counted per cell; a cell is dense if it and the cells around it hold ``min_points`` or more. Dense cells that touch form one
cluster, a point beside a dense cell belongs to that cell's cluster, and all others are noise. Points never meet each other, only
counts of cells do, so a cell with a third of all points is one row like any other. The number of neighbours is 3 to the power of
the dimensions, so this is for points of two or three (``clusters.plane_points``).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut

#: Beyond this a cell has too many neighbours.
MOST_DIMENSIONS = 4


def cell_of(point: Column, size: float) -> Column:
    return F.transform(point, lambda x: F.floor(x / F.lit(float(size))).cast("long"))


def around(cell: str, dimensions: int) -> Column:
    """The cell and those that touch it."""
    steps = itertools.product((-1, 0, 1), repeat=dimensions)
    moved = (F.array(*(F.col(cell)[i] + F.lit(d) for i, d in enumerate(step))) for step in steps)
    return F.explode(F.array(*moved))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (``a``, ``b``) is connected to, smallest nodes included.

    Alternates two joins, each of which hangs neighbours under the smallest one, until nothing changes: a number of rounds that
    grows with the logarithm of the longest way. Each round is a written table.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    nodes = cut(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct())
    # every pair as (larger, smaller)
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large.where(F.col("a") != F.col("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(small.where(F.col("a") != F.col("b")).distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    return nodes.join(now.withColumnsRenamed({"a": "node", "b": "root"}), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def dense_cells(points: DataFrame, size: float, min_points: int, dimensions: int) -> DataFrame:
    """(cell, n, near): occupied cells with their points and the points of the cells around them, dense ones only."""
    counts = cut(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    near = counts.select(around("cell", dimensions).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("near"))
    return counts.join(near, "cell").where(F.col("near") >= min_points)


def cluster_by_density(vectors: DataFrame, size: float, min_points: int = 5, vector: str = "vector", id: str = "id") -> DataFrame:
    """Add ``cluster`` (0, 1, … by falling number of points, −1 for noise) and ``probability`` to points of few dimensions.

    ``size`` is the width of a cell: points that far apart may be neighbours. ``probability`` is how crowded a point's surroundings are
    beside the most crowded ones of its cluster, 0 for noise. A point without vector, with null or non-finite coordinates or with
    other dimensions than the first one's is noise. Repeated points count each time; the number of clusters is small beside that of points.
    """
    rows = cut(vectors.withColumn("cell", cell_of(F.col(vector), size)))
    known = rows.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector))).first()[0]
    dimensions = max(1, known or 1)
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions: project the vectors first (clusters.plane_points)")
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size(vector) == dimensions) & numbers, F.lit(False))
    dense = cut(dense_cells(rows.where(good).select("cell"), size, min_points, dimensions))
    touching = dense.select(F.col("cell").alias("a"), around("cell", dimensions).alias("b"))
    edges = touching.join(dense.select(F.col("cell").alias("b")), "b", "left_semi").select("a", "b")
    root = components(edges)
    # a sparse cell beside dense ones goes to the most crowded of them
    sparse = rows.where(good).select("cell").distinct().join(dense.select("cell"), "cell", "left_anti")
    crowd = dense.join(root, F.col("cell") == F.col("node")).select(F.col("cell").alias("beside"), "near", "root")
    border = sparse.select("cell", around("cell", dimensions).alias("beside")).join(crowd, "beside")
    border = border.groupBy("cell").agg(F.max_by(F.struct("near", "root"), F.struct("near", "beside")).alias("x")).select("cell", "x.near", "x.root")
    cells = cut(crowd.select(F.col("beside").alias("cell"), "near", "root").unionByName(border))
    sized = rows.where(good).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(cells, "cell").groupBy("root").agg(
        F.sum("n").alias("points"), F.max("near").alias("most")
    )
    from pathloom.operators.ordered import numbered

    ranked = numbered(sized.withColumn("__less", -F.col("points")), ["__less", "root"], "__rank")
    named = cells.join(ranked.select("root", "most", "__rank"), "root")
    found = named.select("cell", (F.col("__rank") - 1).cast("int").alias("cluster"), F.round(F.col("near") / F.col("most"), 4).alias("probability"))
    out = rows.withColumn("__good", good).join(found, "cell", "left")
    return out.select(
        *vectors.columns,
        F.when(F.col("__good"), F.coalesce("cluster", F.lit(-1))).otherwise(-1).alias("cluster"),
        F.when(F.col("__good"), F.coalesce("probability", F.lit(0.0))).otherwise(0.0).alias("probability"),
    )
