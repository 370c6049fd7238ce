"""Session settings, and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_CONF = "pathloom.hot.rows"
HOT_ROWS_DEFAULT = 1_000_000
METHOD_CONF, METHOD_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "65535"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "pathloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hot_rows(spark: SparkSession) -> int:
    """Largest number of rows of one key that a single task may order."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def short_methods(spark: SparkSession) -> None:
    """Let no generated method exceed what HotSpot compiles (8 000 bytes), if the session names no limit itself.

    Longer ones are interpreted row by row; above the limit Spark generates code operator by operator, in shorter methods.
    """
    if spark.conf.get(METHOD_CONF, None) in (None, METHOD_DEFAULT):
        spark.conf.set(METHOD_CONF, "8000")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master may fall back to a temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="pathloom-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Later steps neither recompute nor change them, a lost executor costs no more than its own tasks,
    and the table's real size decides about broadcasts. (``checkpoint()`` would compute the rows twice.)
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
