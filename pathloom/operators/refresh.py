"""Refresh of the centroids: assign, move or recluster, profile, judge, write a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.vectors import l2_normalized
from pathloom.operators import clusters as cl, profiles as pf, quality as q
from pathloom.session import cut


def refresh_centroids(
    vectors: DataFrame, long: DataFrame, old: DataFrame, old_profiles: DataFrame, keys: Sequence[str],
    path: str | None = None, alpha: float = 0.3, full: bool = False, ks: Sequence[int] = (4, 8, 16),
) -> dict[str, DataFrame]:
    """New centroids, assignments, profiles, quality and stability of the session ``vectors`` (keys, vector).

    ``full`` clusters anew, otherwise the old centroids move towards the sessions nearest to them.
    Without ``path`` nothing is written. Quality is measured on normalised vectors, the silhouette by squared distances, which is linear
    in the sessions (``quality.silhouette`` gives the Euclidean one).
    """
    unit = l2_normalized(F.col("vector"))
    both = cut(cl.assign_nearest(vectors, old).withColumn("__unit", unit))
    confidence = cl.confidence_summary(both)
    if full:
        # the vectors as they were travel beside the normalised ones, so that labels need not find them again
        rows = both.select(*keys, F.col("vector").alias("__own"), F.col("__unit").alias("vector"))
        labelled = cl.cluster_sessions(rows, ks, written=True)
        both = cut(labelled.select(*keys, F.col("__own").alias("vector"), F.col("vector").alias("__unit"), "cluster"))
        new = cl.centroids(both).select("cluster", "centroid")
    else:
        new = cl.ema_centroids(old, both, alpha)
    new = cut(new)
    assigned, unit = both.drop("__unit"), both.withColumn("vector", F.col("__unit")).drop("__unit")
    profiles = cut(pf.cluster_profiles(long, assigned, keys))
    stability = pf.profile_stability(profiles, old_profiles)
    sizes = q.sizes_and_noise(assigned)
    measures = sizes.withColumns(
        {
            "davies_bouldin": F.round(q.davies_bouldin(unit).scalar(), 4),
            "silhouette": F.round(q.linear_silhouette(unit).scalar(), 4),
            "avg_profile_stability": pf.mean_stability(stability).scalar(),
        }
    )
    judged = pf.cluster_validation(
        pf.unique_labels(profiles).join(stability, on="cluster", how="left"), sizes.select("clustered_session_count").scalar()
    )
    out = {
        "centroids": new, "assignments": assigned.select(*keys, "cluster"), "profiles": judged, "quality": measures,
        "confidence": confidence,
    }
    if path is not None:
        for name, table in out.items():
            table.write.mode("error").parquet(f"{path}/{name}")
    return out
