"""Centroids, nearest-centroid classification and clustering of session vectors.

A vector table has an id, ``vector`` (array<double>) and, where known, ``cluster`` (−1 is noise).
Centroids travel to the tasks if their size, which is checked, allows it. More of them stay a table, whose blocks meet blocks of
vectors; the results are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vectors import EPS, confidence, distance
from pathloom.session import cut

CELLS = 4_000_000  # numbers of one centroid block, 32 MB


def centroids(vectors: DataFrame, by: str = "cluster", noise: bool = False) -> DataFrame:
    """Mean vector and size per cluster, combined map-side; noise is left out."""
    rows = vectors if noise else vectors.where(F.col(by) >= 0)
    out = rows.groupBy(by).agg(
        Summarizer.mean(array_to_vector("vector")).alias("__m"), F.count(F.lit(1)).alias("n")
    )
    return out.select(F.col(by).alias("cluster"), vector_to_array("__m").alias("centroid"), "n")


def one_block(table: DataFrame, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix of the centroids in id order, if they hold at most ``cells`` numbers; else None, and nothing is collected."""
    n, size = table.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if n * (size or 0) > cells:
        return None
    rows = table.select("cluster", "centroid").orderBy("cluster").collect()
    return np.array([r[0] for r in rows], dtype=int), np.array([r[1] for r in rows], dtype=float).reshape(len(rows), size or 0)


def in_blocks(table: DataFrame, cells: int, by: Sequence[str] = ("cluster",)) -> tuple[DataFrame, int]:
    """Rows numbered by ``by`` and cut into blocks of at most ``cells`` numbers: the table with ``__block``, and the number of blocks."""
    from pathloom.operators.ordered import numbered

    n, size = table.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    per_block = max(1, cells // max(1, size or 1))
    ranked = numbered(table, list(by), "__n")
    return ranked.withColumn("__block", F.floor((F.col("__n") - 1) / per_block).cast("int")).drop("__n"), max(1, -(-n // per_block))


def _unit(m: np.ndarray, eps: float) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + eps)


def _nearest(ids: np.ndarray, unit: np.ndarray, eps: float):
    """(vector, best so far) to the better of it and the most similar row of ``unit``."""

    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for vector, best in batches:
            sims = _unit(np.stack(vector.to_numpy()).astype(float), eps) @ unit.T
            at = sims.argmax(axis=1)
            top = sims[np.arange(len(at)), at]
            so_far = best["similarity"].to_numpy(dtype=float)
            better = ~(so_far >= top)
            cluster = np.where(better, ids[at], best["cluster"].fillna(-1)).astype("int32")
            yield pd.DataFrame({"cluster": cluster, "similarity": np.where(better, top, so_far)})

    return F.pandas_udf(run, "cluster int, similarity double")


def _all_distances(unit: np.ndarray, eps: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vector in batches:
            yield pd.Series(list(1.0 - _unit(np.stack(vector.to_numpy()).astype(float), eps) @ unit.T))

    return F.pandas_udf(run, "array<double>")


def _own(ids: np.ndarray, matrix: np.ndarray):
    """(vector, cluster, distance so far) to the distance to the cluster's row, where ``matrix`` has it."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vector, cluster, so_far in batches:
            x, c = np.stack(vector.to_numpy()).astype(float), cluster.to_numpy()
            at = np.minimum(np.searchsorted(ids, c), len(ids) - 1)
            d = np.linalg.norm(x - matrix[at], axis=1)
            yield pd.Series(np.where(ids[at] == c, d, so_far.to_numpy(dtype=float)))

    return F.pandas_udf(run, "double")


def assign_nearest(vectors: DataFrame, table: DataFrame, eps: float = EPS, cells: int = CELLS) -> DataFrame:
    """Add ``cluster`` and ``similarity`` of the most similar centroid by cosine; ties go to the lowest id.

    One matrix product per Arrow batch; no pair of vector and centroid ever becomes a row. Centroids of more than ``cells`` numbers
    stay a table, see ``_nearest_in_blocks``.
    """
    block = one_block(table, cells)
    if block is None:
        return _nearest_in_blocks(vectors, table, eps, cells)
    ids, matrix = block
    best = F.lit(None).cast("struct<cluster:int,similarity:double>")
    out = vectors.withColumn("__best", best)
    if len(ids):
        out = out.withColumn("__best", _nearest(ids, _unit(matrix, eps), eps)("vector", "__best"))
    return out.select(*vectors.columns, "__best.cluster", "__best.similarity")


def _nearest_in_blocks(vectors: DataFrame, table: DataFrame, eps: float, cells: int) -> DataFrame:
    """Blocks of vectors meet blocks of centroids, a pair of blocks in one task; the best of each vector is an aggregate.

    Tasks hold two blocks of at most about ``cells`` numbers, whatever the number of vectors or centroids.
    """
    rows = cut(vectors.withColumn("__row", F.monotonically_increasing_id()))
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    chunks = max(1, -(-n * (size or 1) // cells))
    ranked, count = in_blocks(table.select("cluster", "centroid"), cells)
    left = rows.select("__row", "vector", F.pmod(F.xxhash64("__row"), F.lit(chunks)).cast("int").alias("__chunk"))
    left = left.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    # written: grouping by a column that the optimizer folds to a constant loses columns on their way to Python
    left, right = cut(left), cut(ranked.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))

    def best(mine: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(centres):
            return pd.DataFrame({"__row": [], "cluster": [], "similarity": []}).astype({"__row": "int64", "cluster": "int32", "similarity": float})
        centres = centres.sort_values("cluster")
        sims = _unit(np.stack(mine["vector"].to_numpy()).astype(float), eps) @ _unit(np.stack(centres["centroid"].to_numpy()).astype(float), eps).T
        at = sims.argmax(axis=1)
        return pd.DataFrame({"__row": mine["__row"], "cluster": centres["cluster"].to_numpy()[at], "similarity": sims[np.arange(len(at)), at]})

    pair = ["__block", "__chunk"]
    met = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(best, "__row long, cluster int, similarity double")
    found = met.groupBy("__row").agg(F.max(F.struct("similarity", (-F.col("cluster")).alias("less"))).alias("__b"))
    out = rows.join(found, "__row", "left")
    return out.select(*vectors.columns, (-F.col("__b.less")).alias("cluster"), F.col("__b.similarity").alias("similarity"))


def distances(vectors: DataFrame, table: DataFrame, eps: float = EPS, cells: int = CELLS) -> DataFrame:
    """Add ``distances``, a map from every cluster to 1 − cosine similarity (4 decimals). For centroids of one block."""
    block = one_block(table, cells)
    if block is None:
        raise ValueError("too many centroids for a map in every row; assign_nearest gives the nearest one")
    ids, matrix = block
    keys = F.array(*(F.lit(int(i)) for i in ids))
    to_all = _all_distances(_unit(matrix, eps), eps)("vector")
    return vectors.withColumn("distances", F.map_from_arrays(keys, F.transform(to_all, lambda d: F.round(d, 4))))


def classify_vectors(vectors: DataFrame, table: DataFrame, with_distances: bool = True) -> DataFrame:
    """Cluster and confidence per vector, and all distances if wanted."""
    rows = distances(vectors, table) if with_distances else vectors
    return assign_nearest(rows, table).withColumn("confidence", confidence(F.lit(1.0) - F.col("similarity"))).drop("similarity")


def own_distance(vectors: DataFrame, table: DataFrame, cells: int = CELLS) -> DataFrame:
    """Add ``own_distance``, Euclidean, to the centroid of the vector's own cluster."""
    block = one_block(table, cells)
    if block is None:
        own = table.select("cluster", F.col("centroid").alias("__own"))
        out = vectors.join(own, "cluster", "left")
        return out.select(*vectors.columns, distance(F.col("vector"), F.col("__own")).alias("own_distance"))
    ids, matrix = block
    out = vectors.withColumn("own_distance", F.lit(None).cast("double"))
    return out.withColumn("own_distance", _own(ids, matrix)("vector", "cluster", "own_distance")) if len(ids) else out


def ema_centroids(old: DataFrame, assigned: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(1−α)·old + α·mean of the new vectors; clusters without new vectors stay."""
    new = centroids(assigned).select("cluster", F.col("centroid").alias("__new"))
    moved = F.zip_with("centroid", "__new", lambda o, n: o * (1 - alpha) + n * alpha)
    return old.select("cluster", "centroid").join(new, on="cluster", how="left").select(
        "cluster", F.when(F.col("__new").isNull(), F.col("centroid")).otherwise(moved).alias("centroid")
    )


def confidence_summary(assigned: DataFrame) -> DataFrame:
    """Sessions and mean similarity per cluster, and over all (cluster null)."""
    return assigned.rollup("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 4).alias("mean_confidence"))


# --- token counts as sparse vectors ------------------------------------------------------------------


def tf_vectors(long: DataFrame, vocab: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token counts per session over the vocabulary with norm 1, unknown tokens ignored: (keys, token_id, weight)."""
    ids = long.join(vocab.select("token", F.col("id").alias("token_id")), on="token")
    return _unit_counts(ids.groupBy(*keys, "token_id").agg(F.count(F.lit(1)).alias("c")), keys)


def _unit_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    size = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("__norm"))
    return counts.join(size, on=list(keys)).select(*keys, "token_id", (F.col("c") / F.col("__norm")).alias("weight"))


def token_centroids(long: DataFrame, assignments: DataFrame, vocab: DataFrame, keys: Sequence[str], unk: int = 1) -> DataFrame:
    """Summed token counts per cluster with norm 1, unknown tokens as one: (cluster, token_id, weight).

    Tokens are counted per session before clusters come in, so the join is small.
    """
    from pathloom.operators.vocab import encode_tokens

    per_session = encode_tokens(long, vocab, unk).groupBy(*keys, "token_id").agg(F.count(F.lit(1)).alias("c"))
    counts = per_session.join(assignments.select(*keys, "cluster"), on=list(keys)).groupBy("cluster", "token_id").agg(
        F.sum("c").alias("c")
    )
    return _unit_counts(counts, ["cluster"])


def classify_sessions(long: DataFrame, vocab: DataFrame, table: DataFrame, keys: Sequence[str], with_distances: bool = False) -> DataFrame:
    """Nearest token centroid per session with confidence, length and mode.

    Sessions meet centroids through the tokens they share; a cluster without a shared token has similarity 0, and a session that
    shares none goes to the first cluster. ``with_distances`` adds a map to all clusters, for few of them.
    """
    vectors = tf_vectors(long, vocab, keys)
    scores = vectors.join(table.withColumnRenamed("weight", "__w"), on="token_id").groupBy(*keys, "cluster").agg(
        F.sum(F.col("weight") * F.col("__w")).alias("s")
    )
    nearest = F.max(F.struct("s", (-F.col("cluster")).alias("less"))).alias("__b")
    lists = [F.map_from_entries(F.collect_list(F.struct("cluster", "s"))).alias("__s")] if with_distances else []
    found = scores.groupBy(*keys).agg(nearest, *lists)
    lengths = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("seq_len"))
    first = table.agg(F.min("cluster").alias("c")).select("c").scalar()
    rows = lengths.join(found, on=list(keys), how="left").withColumn("__first", first)
    out = [
        F.coalesce(-F.col("__b.less"), F.col("__first")).alias("cluster"),
        confidence(F.lit(1.0) - F.coalesce(F.col("__b.s"), F.lit(0.0))).alias("confidence"),
    ]
    if with_distances:
        rows = rows.withColumn("__ids", table.agg(F.array_sort(F.collect_set("cluster")).alias("ids")).select("ids").scalar())
        away = F.transform("__ids", lambda c: F.round(F.lit(1.0) - F.coalesce(F.col("__s")[c], F.lit(0.0)), 4))
        out.append(F.map_from_arrays("__ids", away).alias("distances"))
    return rows.select(*keys, *out, "seq_len", F.lit("token_counts").alias("mode"))


# --- learned ---------------------------------------------------------------------------------------


def w2v_vectors(long: DataFrame, keys: Sequence[str], size: int = 64, window: int = 5, seed: int = 42) -> DataFrame:
    """Session vectors as the mean of word vectors learned from the sequences."""
    from pyspark.ml.feature import Word2Vec

    from pathloom.operators.sequences import in_parts

    parts = cut(in_parts(long, keys, "token").withColumn("__n", F.size("values").cast("double")))
    # one training task per about a million tokens; each trains on its own share and the results are averaged
    tasks = max(1, math.ceil((parts.agg(F.sum("__n")).first()[0] or 0) / 1_000_000))
    trained = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, numPartitions=tasks, inputCol="values", outputCol="__v")
    model = trained.fit(parts.select("values"))
    # a session of one part has that part's mean; only the parts of longer ones must meet
    long_ones = cut(parts.where(F.col("part") > 0).select(*keys).distinct())
    same = [parts[k].eqNullSafe(long_ones[k]) for k in keys]
    one = model.transform(parts.join(long_ones, on=same, how="left_anti"))
    more = model.transform(parts.join(long_ones, on=same, how="left_semi"))
    more = more.groupBy(*keys).agg(Summarizer.mean(F.col("__v"), F.col("__n")).alias("__v"))
    return one.select(*keys, "__v").unionByName(more).select(*keys, vector_to_array("__v").alias("vector"))


def plane_points(vectors: DataFrame) -> DataFrame:
    """Add ``pca_x`` and ``pca_y`` for plotting."""
    from pyspark.ml.feature import PCA

    rows = vectors.withColumn("__f", array_to_vector("vector"))
    model = PCA(k=2, inputCol="__f", outputCol="__p").fit(rows.select("__f"))
    xy = vector_to_array("__p")
    return model.transform(rows).withColumns({"pca_x": xy[0], "pca_y": xy[1]}).drop("__f", "__p")


def cluster_sessions(
    vectors: DataFrame, ks: Sequence[int] = (4, 8, 16), min_size: int = 3, quantile: float = 0.95, seed: int = 42, written: bool = False
) -> DataFrame:
    """Cluster with noise: k-means with the best silhouette, then far vectors and tiny clusters become −1.

    A distributed stand-in for density clustering; labels differ, quality measures are comparable.
    ``probability`` is 1 at the centre and falls to 0 at the noise border. ``written`` says that ``vectors`` are columns of a written table.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = (vectors if written else cut(vectors)).withColumn("__f", array_to_vector("vector"))
    judge = ClusteringEvaluator(featuresCol="__f", predictionCol="cluster")
    best, top = None, -2.0
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster").fit(rows)
        labelled = model.transform(rows)
        score = judge.evaluate(labelled) if model.summary.k > 1 else -1.0
        if score > top:
            best, top = labelled, score
    rows = best.drop("__f")
    table = centroids(rows)
    rows = own_distance(rows, table)
    border = rows.groupBy("cluster").agg(
        F.percentile_approx("own_distance", quantile, 10_000).alias("__border"), F.count(F.lit(1)).alias("__n")
    )
    rows = rows.join(border, on="cluster")
    noise = (F.col("own_distance") > F.col("__border")) | (F.col("__n") < min_size)
    inside = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("own_distance") / F.greatest("__border", F.lit(EPS)))
    return rows.withColumns(
        {"probability": F.when(noise, 0.0).otherwise(inside), "cluster": F.when(noise, -1).otherwise(F.col("cluster"))}
    ).drop("own_distance", "__border", "__n")


def score_sequences(
    encoded: DataFrame, encoder: Callable[[np.ndarray, np.ndarray], np.ndarray], keys: Sequence[str], pooling: str = "mean"
) -> DataFrame:
    """Run the caller's encoder over encoded sequences: ids and mask in, one vector per position out.

    ``encoder(input_ids, attention_mask)`` returns (rows, positions, width); the mean of the real
    positions or the first position becomes the session vector.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, mask in batches:
            m = np.stack(mask.to_numpy()).astype(float)
            states = np.asarray(encoder(np.stack(ids.to_numpy()), m))
            if pooling == "first":
                pooled = states[:, 0, :]
            else:
                pooled = (states * m[:, :, None]).sum(axis=1) / np.maximum(m.sum(axis=1, keepdims=True), 1.0)
            yield pd.Series(list(pooled.astype(float)))

    udf = F.pandas_udf(run, "array<double>")
    return encoded.select(*keys, udf("input_ids", "attention_mask").alias("vector"))
