"""Readers: events from JSON, JSON lines, CSV and tables, sequences, and an external clickstream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.payload import ENVELOPE

# a payload arrives as an object, the typed columns are read from its text
_BARE = T.StructType([f for f in ENVELOPE.fields if f.name != "data"])

EXTERNAL = T.StructType([
    T.StructField("session_id_hash", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("product_action", T.StringType()),
    T.StructField("server_timestamp_epoch_ms", T.LongType()),
    T.StructField("page_url", T.StringType()),
])


def valid(events: DataFrame) -> DataFrame:
    """Events with a type; anything else is not an event."""
    return events.where(F.col("event_type").isNotNull())


def unwrap(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events from JSON texts that hold ``{"events": […]}``, a list, or one event."""
    v = F.try_parse_json(F.col(value))
    listed = F.coalesce(F.try_variant_get(v, "$.events", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    each = lines.select(*(c for c in lines.columns if c != value), F.explode(listed).alias("e"))
    # a type that is no text is no type
    kind = F.try_variant_get("e", "$.event_type", "variant")
    read = {"event_type": F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get("e", "$.event_type", "string"))}
    fields = [read.get(f.name, F.try_variant_get("e", f"$.{f.name}", f.dataType.simpleString())).alias(f.name) for f in _BARE.fields]
    data = F.try_variant_get("e", "$.data", "variant")
    kept = [c for c in lines.columns if c != value and c not in _BARE.names]
    rows = each.select(*kept, *fields, F.to_json(data).alias("data"))
    return valid(rows)


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines; ``multi_line`` for files that hold one list or one batch object each."""
    return unwrap(spark.read.text(path, wholetext=multi_line))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with header; numbers that are none become null, the payload stays text.

    ``multi_line`` for files with line breaks inside quotes; such a file is read by one task.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', encoding="UTF-8", multiLine=multi_line)
    names = {c: c.lstrip("﻿") for c in raw.columns}
    raw = raw.withColumnsRenamed(names)
    numbers = {"timestamp": "double", "event_seq": "double", "event_token": "double", "inter_event_gap": "double"}
    present = {n: F.col(n).try_cast(t).cast("long") for n, t in numbers.items() if n in raw.columns}
    return valid(raw.withColumns(present))


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """Any table of the caller's catalog; only the named columns are read."""
    t = spark.table(name)
    return t.select(*columns) if columns else t


def save_collection(
    events: DataFrame, name: str, buckets: int, path: str | None = None, session: Sequence[str] = ("session_id",),
    order: Sequence[str] = ("timestamp", "event_seq", "event_id"),
) -> None:
    """Store events as a table bucketed by session and sorted by time, which session jobs read without a shuffle.

    One file per bucket. A session lies in one bucket whole; sessions beyond ``pathloom.hot.rows`` are cut into ranges when they are
    read, as from any table. ``path`` makes the table external; columns of ``order`` that are missing play no part.
    """
    sort = [*session, *(c for c in order if c in events.columns)]
    out = events.repartition(buckets, *session).write.mode("overwrite").bucketBy(buckets, *session).sortBy(*sort)
    (out.option("path", path) if path else out).saveAsTable(name)


def read_collection(spark: SparkSession, name: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """A stored collection: all of it, the named columns, or its first ``limit`` events by session and time."""
    t = spark.table(name)
    if limit is not None:
        t = t.orderBy(*(c for c in ("session_id", "timestamp", "event_seq", "event_id") if c in t.columns)).limit(limit)
    return t.select(*columns) if columns else t


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """External clickstream CSV; only the columns used are parsed, splits are read in parallel."""
    head = spark.read.csv(path, header=True).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.select(*(
        (F.col(f.name).try_cast(f.dataType) if f.name in head else F.lit(None).cast(f.dataType)).alias(f.name) for f in EXTERNAL.fields
    ))


def read_sequences(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Sequences written as text or as lists: (session_id, start_timestamp, end_timestamp, length, sequence array)."""
    if fmt == "csv":
        raw = spark.read.csv(path, header=True)
        return raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns}).select(
            "session_id", F.col("start_timestamp").try_cast("double").cast("long").alias("start_timestamp"),
            F.col("end_timestamp").try_cast("double").cast("long").alias("end_timestamp"), F.col("length").try_cast("long").alias("length"),
            F.filter(F.split(F.trim(F.coalesce("sequence", F.lit(""))), r"\s+"), lambda t: t != "").alias("sequence"),
        )
    schema = "session_id string, start_timestamp double, end_timestamp double, length long, sequence array<string>"
    raw = spark.read.schema(schema).json(path) if fmt == "json" else spark.read.parquet(path)
    return raw.withColumns({c: F.col(c).cast("long") for c in ("start_timestamp", "end_timestamp")})


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) from a written vocabulary, or from a JSON object ``{"token_to_id": {…}}`` or ``{token: id}``."""
    if not path.endswith(".json"):
        return spark.read.parquet(path).select("token", "id")
    whole = spark.read.text(path, wholetext=True)
    ids = F.coalesce(
        F.from_json("value", "token_to_id map<string,int>")["token_to_id"], F.from_json("value", "map<string,int>")
    )
    return whole.select(F.explode(ids).alias("token", "id"))
