"""How good clusters and predictions are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.clusters import CELLS, centroids, in_blocks, own_distance
from pathloom.session import cut


def sizes_and_noise(labels: DataFrame) -> DataFrame:
    """Sample, clustered and noise counts and the noise rate."""
    out = labels.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.col("cluster") >= 0).alias("clustered_session_count"),
        F.count_if(F.col("cluster") < 0).alias("noise_count"),
    )
    rate = F.round(F.try_divide(F.col("noise_count"), F.col("sample_count")), 4)
    return out.withColumn("noise_rate", rate)


TILE = 2_048  # rows of a tile of distances, 32 MB


def block_count(rows: int, size: int, cells: int = CELLS) -> int:
    """Blocks of at most about ``cells`` numbers, and for many rows at least eight, so that pairs of blocks keep a cluster busy."""
    return max(1, -(-rows * size // cells), min(8, rows // TILE))


def silhouettes(vectors: DataFrame, id_: str, cells: int = CELLS) -> DataFrame:
    """Exact Euclidean silhouette of every clustered vector: (id, cluster, silhouette).

    Vectors are dealt into hashed blocks of about ``cells`` numbers. Each pair of blocks meets once, in one task, and gives distance sums per
    vector and cluster, never pairs. The work is quadratic; a vector travels twice per block, and blocks are as large as memory allows.
    """
    rows = vectors.where(F.col("cluster") >= 0).select(F.col(id_).alias("id"), "cluster", "vector")
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    count = block_count(n, size or 1, cells)
    # the numbers of the blocks are written: a column that the optimizer folds to a constant is lost on its way to Python
    dealt = cut(rows.withColumns({"__block": F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"), "__all": F.sequence(F.lit(0), F.lit(count - 1))}))
    left = dealt.select("id", "cluster", "vector", "__block", F.explode("__all").alias("__other"))
    right = dealt.select("cluster", "vector", F.col("__block").alias("__other"), F.explode("__all").alias("__block"))

    def sums(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"id": mine["id"][:0], "cluster": [], "near": [], "total": [], "n": []})
        theirs = theirs.sort_values("cluster", kind="stable")
        x, y = (np.stack(p["vector"].to_numpy()).astype(float) for p in (mine, theirs))
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        names, starts = np.unique(theirs["cluster"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(y))
        total = np.zeros((len(x), len(names)))
        for i in range(0, len(x), TILE):
            for j, (start, end) in enumerate(zip(starts, ends)):
                for k in range(start, end, TILE):
                    upto = min(k + TILE, end)
                    d = x[i : i + TILE] @ y[k:upto].T
                    d *= -2
                    d += xx[i : i + TILE, None]
                    d += yy[None, k:upto]
                    np.maximum(d, 0.0, out=d)
                    total[i : i + TILE, j] += np.sqrt(d, out=d).sum(axis=1)
        return pd.DataFrame({
            "id": np.repeat(mine["id"].to_numpy(), len(names)), "cluster": np.repeat(mine["cluster"].to_numpy(), len(names)),
            "near": np.tile(names, len(x)), "total": total.ravel(), "n": np.tile(ends - starts, len(x)),
        })

    kind = rows.schema["id"].dataType.simpleString()
    pair = ["__block", "__other"]
    met = left.groupBy(*pair).cogroup(right.groupBy(*pair))
    parts = met.applyInPandas(sums, f"id {kind}, cluster int, near int, total double, n long")
    near = parts.groupBy("id", "cluster", "near").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    own = F.col("near") == F.col("cluster")
    per = near.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.col("n"))).alias("mates"),
        F.max(F.when(own, F.try_divide(F.col("t"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("t") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("mates") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per.select("id", "cluster", s.alias("silhouette"))


def _enough(vectors: DataFrame, value: Column) -> DataFrame:
    """Null below two clusters or three vectors."""
    sizes = vectors.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.when((F.count(F.lit(1)) >= 2) & (F.sum("n") >= 3), value).alias("silhouette"))


def silhouette(vectors: DataFrame, id_: str) -> DataFrame:
    """Mean exact Euclidean silhouette; its work grows with the square of the rows, see ``linear_silhouette``."""
    mean = silhouettes(vectors, id_).agg(F.avg("silhouette").alias("s"))
    return _enough(vectors, mean.scalar())


def linear_silhouette(vectors: DataFrame) -> DataFrame:
    """Mean silhouette by squared Euclidean distances, from sums per cluster: linear in the rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col("cluster") >= 0)
    checked = _enough(rows, F.lit(0.0))
    if checked.first()[0] is None:
        return checked
    value = ClusteringEvaluator(featuresCol="__f", predictionCol="cluster").evaluate(rows.withColumn("__f", array_to_vector("vector")))
    return _enough(rows, F.lit(value))


def _spread(vectors: DataFrame) -> DataFrame:
    """Per cluster: centroid, size, mean and summed squared distance to the centroid."""
    clustered = vectors.where(F.col("cluster") >= 0)
    table = cut(centroids(clustered))
    d = own_distance(clustered, table).groupBy("cluster").agg(
        F.avg("own_distance").alias("s"), F.sum(F.col("own_distance") * F.col("own_distance")).alias("within")
    )
    return table.join(d, on="cluster")


def davies_bouldin(vectors: DataFrame, cells: int = 65_536) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij.

    Clusters are compared in pairs of blocks of at most ``cells`` numbers, one pair in a task; the worst of each is an aggregate.
    """
    spread = cut(_spread(vectors).select("cluster", "centroid", "s", "n"))
    k, n = spread.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocked, count = in_blocks(spread.select("cluster", "centroid", "s"), cells)
    others = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # written, since grouping by a column that the optimizer folds to a constant loses columns on their way to Python
    left, right = cut(blocked.withColumn("__other", others)), cut(blocked.withColumnRenamed("__block", "__other").withColumn("__block", others))

    def worst(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"cluster": [], "worst": []})
        x, y = (np.stack(p["centroid"].to_numpy()).astype(float) for p in (mine, theirs))
        top = np.zeros(len(x))
        for i in range(len(x)):  # a row at a time: the difference is exact where the product form is not
            d = np.sqrt(((x[i] - y) ** 2).sum(1))
            ratio = np.divide(mine["s"].iloc[i] + theirs["s"].to_numpy(), d, out=np.zeros(len(y)), where=d > 0)
            ratio[theirs["cluster"].to_numpy() == mine["cluster"].iloc[i]] = 0.0
            top[i] = ratio.max(initial=0.0)
        return pd.DataFrame({"cluster": mine["cluster"], "worst": top})

    pair = ["__block", "__other"]
    met = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(worst, "cluster int, worst double")
    mean = met.groupBy("cluster").agg(F.max("worst").alias("worst")).agg(F.avg("worst").alias("m"))
    return mean.select(F.when(F.lit(k >= 2 and n >= 3), F.col("m")).alias("davies_bouldin"))


def calinski_harabasz(vectors: DataFrame) -> DataFrame:
    """Ratio of between- and within-cluster dispersion."""
    spread = cut(_spread(vectors).select("cluster", "centroid", "n", "within"))
    dims = spread.select("n", "within", F.posexplode("centroid").alias("i", "c"))
    per_dim = dims.groupBy("i").agg(
        (F.sum(F.col("n") * F.col("c") * F.col("c")) - F.sum(F.col("n") * F.col("c")) ** 2 / F.sum("n")).alias("b")
    )
    between = per_dim.agg(F.sum("b").alias("b")).select("b").scalar()
    out = spread.agg(F.sum("within").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ratio = F.try_divide(between / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))
    return out.select(F.when(F.col("k") >= 2, ratio).alias("calinski_harabasz"))


# --- predictions -------------------------------------------------------------------------------------


def majority_predictions(rows: DataFrame, label: str = "is_churned") -> DataFrame:
    """Predict a session's label by its cluster's majority; noise counts as churned. Adds y_true, y_prob, y_pred."""
    rate = rows.where(F.col("cluster") >= 0).groupBy("cluster").agg(F.avg(F.col(label).cast("double")).alias("__rate"))
    prob = F.when(F.col("cluster") == -1, F.lit(1.0)).otherwise(F.coalesce(F.col("__rate"), F.lit(0.5)))
    out = rows.join(rate, on="cluster", how="left").withColumns({"y_true": F.col(label).cast("int"), "y_prob": prob})
    return out.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int")).drop("__rate")


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(rows: DataFrame) -> DataFrame:
    t, p = F.col("y_true"), F.col("y_pred")
    return rows.agg(
        *(F.count_if((t == i) & (p == j)).alias(n) for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
    )


def classification_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and weighted F1 with the confusion matrix; 0 where undefined."""
    c = confusion(rows)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    f1 = _safe(2 * tp, 2 * tp + fp + fn)
    f0 = _safe(2 * tn, 2 * tn + fp + fn)
    return c.select(
        "tn", "fp", "fn", "tp",
        _safe(tp + tn, n).alias("accuracy"), _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
        f1.alias("f1"), _safe(f1 * (tp + fn) + f0 * (tn + fp), n).alias("f1_weighted"),
    )


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    c = confusion(rows)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))

    def row(y: int, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(y).alias("class"), _safe(hit, hit + wrong).alias("precision"), _safe(hit, hit + missed).alias("recall"),
            _safe(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"),
        )

    return c.select(F.inline(F.array(row(0, tn, fn, fp), row(1, tp, fp, fn))))


def auc_metrics(rows: DataFrame) -> DataFrame:
    """ROC-AUC (equal scores count half) and average precision, from counts per distinct score.

    The running counts over scores go through ``ordered``, so many distinct scores do not end in one task.
    """
    from pathloom.operators.ordered import ordered, running_sum

    by_score = rows.groupBy((-F.col("y_prob")).alias("__low")).agg(
        F.count_if(F.col("y_true") == 1).alias("p"), F.count_if(F.col("y_true") == 0).alias("q"), F.lit(0).alias("__all")
    )
    run = ordered(cut(by_score), ["__all"], ["__low"], lambda k: k.add(tp=running_sum(F.col("p")), fp=running_sum(F.col("q"))).df)
    # a negative loses to the positives above it and ties with those beside it
    won = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2))
    total = F.sum("p") * F.sum("q")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return run.agg(
        F.try_divide(won, total).alias("roc_auc"), F.try_divide(F.sum(F.col("p") * precision), F.sum("p")).alias("pr_auc")
    )
