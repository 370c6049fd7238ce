"""WARC (1): what a "not modified" revisit stands for.

A revisit record holds headers only. Its content is that of the latest earlier full response of the same canonical URL,
provided the validators agree; the 304's permitted headers then replace the stored ones, as a cache would do it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.ordered import ordered, prev_known

#: Headers that a 304 may update (RFC 9110, 15.4.5, and Last-Modified and Age). Fixed values.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name content.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without trailing slash, parameters sorted without trackers; http and https agree.

    Null stays null; a text without ``://`` stays as it is.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER), r"\.?(:80|:443)?$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    given = F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~F.coalesce(p.rlike(TRACKING), F.lit(False))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query)).otherwise(url)


def header(headers: Column, name: str) -> Column:
    """The last value of a header, names without regard to case; null if it is missing."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def merged_headers(stored: Column, update: Column, permitted: Sequence[str] = PERMITTED) -> Column:
    """Stored headers without those that the update may and does replace, then the update's permitted ones."""
    allowed = F.filter(update, lambda h: F.lower(h["name"]).isin(*permitted))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    left = F.filter(stored, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False)))
    return F.concat(left, allowed)


def resolve_revisits(records: DataFrame, permitted: Sequence[str] = PERMITTED) -> DataFrame:
    """Every revisit with the response it stands for: (record_id, url, ts, state, refers_to, validator, payload_digest, headers).

    ``records``: record_id, url, ts (any ordered type), type (``response`` or ``revisit``), payload_digest, headers (name, value pairs).
    The candidate is the latest response of strictly earlier time; of several at that time, the one with the greatest
    (record_id, digest). ETags decide where both sides have one (weak comparison), else Last-Modified, else the payload digests.
    A digest that both sides have must agree in any case.

    state: ``resolved``; ``differs`` (the deciding validator does not agree; candidate given, headers and digest the revisit's own);
    ``no validator``; ``no response``; ``no key`` (null URL or time). Null headers count as none. Other types of
    record, null types included, play no part. Repeated rows are resolved each. Extra columns are left out.
    One shuffle by URL; bodies do not travel, hot URLs are cut into ranges by ``ordered``.
    """
    own = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", "url", "ts", "payload_digest",
        (F.col("type") == "response").alias("full"),
        F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"),
        canonical_url(F.col("url")).alias("key"),
        F.monotonically_increasing_id().alias("tie"),
    )
    usable = F.col("key").isNotNull() & F.col("ts").isNotNull()
    # at equal times revisits come first, so a response never answers one of its own time; the digest is lost on none
    response = F.when(
        F.col("full"),
        F.struct(
            "record_id", "payload_digest", "headers", header(F.col("headers"), "etag").alias("etag"),
            header(F.col("headers"), "last-modified").alias("modified"),
        ),
    )
    order = ["ts", "full", "record_id", "payload_digest", "tie"]
    found = ordered(
        own.where(usable).withColumn("response", response), ["key"], order,
        lambda k: k.add(stored=prev_known(F.col("response"))).where(~F.col("full")).df,
    ).drop("response")
    lost = own.where(~usable & ~F.col("full")).withColumn("stored", F.lit(None).cast(found.schema["stored"].dataType))

    def weak(tag: Column) -> Column:
        return F.regexp_replace(F.trim(tag), "^[Ww]/", "")

    etag, modified = header(F.col("headers"), "etag"), header(F.col("headers"), "last-modified")
    digests = F.col("payload_digest").isNotNull() & F.col("stored.payload_digest").isNotNull()
    same_digest = F.col("payload_digest") == F.col("stored.payload_digest")
    validator = (
        F.when(etag.isNotNull() & F.col("stored.etag").isNotNull(), "etag")
        .when(modified.isNotNull() & F.col("stored.modified").isNotNull(), "last-modified")
        .when(digests, "digest")
    )
    agrees = (
        F.when(F.col("validator") == "etag", weak(etag) == weak(F.col("stored.etag")))
        .when(F.col("validator") == "last-modified", F.trim(modified) == F.trim(F.col("stored.modified")))
        .otherwise(same_digest)
    ) & (~digests | same_digest)
    state = (
        F.when(F.col("key").isNull() | F.col("ts").isNull(), "no key")
        .when(F.col("stored").isNull(), "no response")
        .when(F.col("validator").isNull(), "no validator")
        .when(agrees, "resolved")
        .otherwise("differs")
    )
    resolved = F.col("state") == "resolved"
    return (
        found.unionByName(lost)
        .withColumn("validator", validator)
        .withColumn("state", state)
        .select(
            "record_id", "key", "url", "ts", "state",
            F.col("stored.record_id").alias("refers_to"),
            "validator",
            F.when(resolved, F.col("stored.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
            F.when(resolved, merged_headers(F.col("stored.headers"), F.col("headers"), permitted)).otherwise(F.col("headers")).alias("headers"),
        )
    )
