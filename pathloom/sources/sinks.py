"""Writers for features, sequences, encodings, vocabularies, cluster results and site snapshots."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.urls import normalize_origin, site_key


def stamped(folder: str, name: str) -> str:
    """A path that sorts by the time it was written."""
    return f"{folder}/{name}_{datetime.datetime.now():%Y%m%d_%H%M%S}"


def write_features(features: DataFrame, folder: str, fmt: str = "csv") -> str:
    path = stamped(folder, "session_features")
    features.write.mode("error").format(fmt).option("header", True).save(path)
    return path


def write_sequences(sequences: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV holds the tokens joined by spaces, JSON lines and Parquet keep the array."""
    out = sequences.withColumn("sequence", F.array_join("sequence", " ")) if fmt == "csv" else sequences
    out.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """One line per audited event; lines of a session share its id, none is gathered into one value."""
    audit.write.mode("overwrite").json(path)


def write_encoded(encoded: DataFrame, path: str, fmt: str = "parquet", padded: bool = True) -> None:
    """CSV holds lists as numbers joined by spaces. Without ``padded`` the used ids and the padded length stand for ids and mask."""
    out = encoded
    if not padded:
        used = F.slice("input_ids", F.lit(1), F.col("used_length"))
        out = out.withColumns({"padded_length": F.size("input_ids"), "input_ids": used}).drop("attention_mask")
    if fmt == "csv":
        lists = [f.name for f in out.schema.fields if f.dataType.typeName() == "array"]
        out = out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in lists})
    out.write.mode("overwrite").format(fmt).option("header", True).save(path)


def read_encoded(spark: SparkSession, path: str, fmt: str = "parquet", pad: int = 0) -> DataFrame:
    """What ``write_encoded`` wrote, with lists as lists and the padding restored."""
    out = spark.read.option("header", True).format(fmt).load(path)
    if fmt == "csv":
        numbers = {c: F.col(c).cast("int") for c in ("used_length", "padded_length") if c in out.columns}
        lists = {c: F.split(F.coalesce(c, F.lit("")), " ").try_cast("array<int>") for c in ("input_ids", "attention_mask") if c in out.columns}
        out = out.withColumns({**numbers, **lists})
    if "padded_length" in out.columns:
        used = F.col("used_length")
        ids = F.when(used > 0, F.col("input_ids")).otherwise(F.array().cast("array<int>"))
        gap = F.col("padded_length") - used
        mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), gap))
        out = out.withColumns({"attention_mask": mask, "input_ids": F.concat(ids, F.array_repeat(F.lit(pad), gap))}).drop("padded_length")
    return out


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def write_clusters(results: DataFrame, path: str) -> None:
    """session_id, cluster, probability, pca_x, pca_y and whatever else the rows carry."""
    results.write.mode("overwrite").parquet(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- snapshots -----------------------------------------------------------------------------------------


def save_snapshots(clusters: DataFrame, path: str, saved_at: Column) -> None:
    """Freeze each site's clusters; a site's earlier snapshot is replaced, other sites stay."""
    out = clusters.withColumns({"snapshot_origin": normalize_origin(F.col("origin")), "snapshot_saved_at": saved_at})
    out = out.withColumn("site", site_key(F.col("origin")))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_fallback(sites: DataFrame, snapshots: DataFrame, everyone: DataFrame) -> DataFrame:
    """Clusters per site: its own snapshot, else the global profiles, with ``source`` telling which.

    ``sites`` has ``site``; snapshots and global rows share their remaining columns.
    """
    common = [c for c in everyone.columns if c in snapshots.columns]
    own = sites.join(snapshots.select("site", *common), on="site").withColumn("source", F.lit("site_snapshot"))
    missing = sites.join(snapshots.select("site").distinct(), on="site", how="left_anti")
    # every site without a snapshot gets the few global rows: a list of them travels with the site
    rows = everyone.agg(F.collect_list(F.struct(*common)).alias("rows")).select("rows").scalar()
    rest = missing.select("site", F.inline(rows)).withColumn("source", F.lit("global_meta_fallback"))
    return own.unionByName(rest)


def latest(paths: DataFrame, by: str = "modificationTime") -> DataFrame:
    """The newest path of a listing (``binaryFile`` metadata or a table of runs)."""
    return paths.agg(F.max_by("path", F.struct(by, "path")).alias("path"), F.max(by).alias(by))
