"""Versions of cluster tables per site, published by pointers, and what a site shows in each mode.

A version is written first and published by one pointer row, so a reader sees whole versions or none. The artifact of all sites is
a version of the owner ``ALL``. Which version a site shows is a small table; its rows come by a join on owner and version, so no row of
any version travels inside a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.urls import normalize_origin, site_key

#: Owner of the artifact.
ALL = "*"
POINTER = "owner string, version string, saved_at timestamp"
# What a row's source is called.
FROZEN, LIVE, ARTIFACT, ARTIFACT_FROZEN, FALLBACK = "site_snapshot", "site_live", "artifact", "artifact_snapshot", "artifact_fallback"


def publish(clusters: DataFrame, root: str, version: str, saved_at: Column, origin: str | None = "origin") -> None:
    """Store ``clusters`` as one version for each of its sites (``origin``), or as the artifact if that is None.

    A version written again replaces itself; it becomes visible with its pointers.
    """
    owner = F.lit(ALL) if origin is None else site_key(F.col(origin))
    rows = clusters.withColumn("owner", owner)
    if origin is not None:
        rows = rows.withColumn("snapshot_origin", normalize_origin(F.col(origin)))
    path = f"{root}/rows/version={version}"
    rows.write.mode("overwrite").parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    pointers = stored.select("owner").distinct().select("owner", F.lit(version).alias("version"), saved_at.cast("timestamp").alias("saved_at"))
    pointers.write.mode("overwrite").parquet(f"{root}/pointers/version={version}")


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The version of each owner that was saved last; of equal times the larger name."""
    pointers = spark.read.schema("owner string, saved_at timestamp, version string").parquet(f"{root}/pointers")
    last = pointers.groupBy("owner").agg(F.max(F.struct("saved_at", "version")).alias("p"))
    return last.select("owner", "p.version", "p.saved_at")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All published rows, with ``owner`` and ``version``; versions of other shapes give nulls."""
    return spark.read.option("mergeSchema", True).parquet(f"{root}/rows").withColumn("version", F.col("version").cast("string"))


def choose(sites: DataFrame, pointers: DataFrame, mode: str, live: DataFrame | None = None) -> DataFrame:
    """(site, owner, version, source, saved_at): what each of ``sites`` shows.

    * ``frozen``: the site's newest snapshot, else the artifact;
    * ``live``: its sessions classified now (``live`` has rows by site), else the artifact as fallback;
    * ``artifact``: the artifact.
    """
    every = sites.select("site").distinct()
    artifact = pointers.where(F.col("owner") == ALL).select(F.lit(ALL).alias("owner"), F.col("version").alias("__v"), F.col("saved_at").alias("__at"))
    shown = {"frozen": ARTIFACT_FROZEN, "live": FALLBACK, "artifact": ARTIFACT}[mode]
    own, source = None, None
    if mode == "frozen":
        own, source = pointers.withColumnRenamed("owner", "site"), FROZEN
    elif mode == "live" and live is not None:
        own = live.select("site").distinct().select("site", F.lit("live").alias("version"), F.lit(None).cast("timestamp").alias("saved_at"))
        source = LIVE
    rows = every.withColumns({"version": F.lit(None).cast("string"), "saved_at": F.lit(None).cast("timestamp")}) if own is None else every.join(own, "site", "left")
    has = F.col("version").isNotNull()
    rows = rows.withColumns({"owner": F.when(has, F.col("site")).otherwise(ALL), "source": F.when(has, F.lit(source)).otherwise(shown)})
    return rows.join(artifact, "owner", "left").select(
        "site", "owner", F.coalesce("version", "__v").alias("version"), "source", F.coalesce("saved_at", "__at").alias("saved_at")
    )


def show(chosen: DataFrame, published: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """The rows of what was chosen: one join on owner and version. ``live`` has ``site`` and the published columns."""
    rows = published
    if live is not None:
        now = live.withColumnRenamed("site", "owner").withColumn("version", F.lit("live"))
        rows = published.unionByName(now, allowMissingColumns=True)
    return chosen.join(rows, ["owner", "version"])
