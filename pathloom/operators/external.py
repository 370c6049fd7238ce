"""Sequences and labels from an external shop clickstream: session_id_hash, event_type, product_action,
server_timestamp_epoch_ms and, sometimes, page_url."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.pages import external_page
from pathloom.functions.rules import blank_to_null, lookup
from pathloom.functions.tokens import external_token
from pathloom.operators.ordered import Keyed, lag, numbered, ordered, prev_known, running_sum
from pathloom.operators.vocab import hash_of

KEY = ["session_id_hash"]
TIME = "server_timestamp_epoch_ms"
START = "HOME|START_SESSION|NONE"


def external_sequences(
    events: DataFrame, order: list[str], min_len: int = 3, max_len: int | None = None, by_url: bool = False, prefix: str = "ext_",
    id_chars: int | None = None, bounded: bool = False,
) -> DataFrame:
    """One row per session: tokens after a start token, too short sessions left out, all tokens or the first ``max_len`` kept.

    ``by_url`` tells page views apart by URL, drops repeats, and counts the start token into ``max_len``. ``id_chars``
    shortens session ids, which may make two sessions one name; by default they stay whole.
    """
    page = external_page(F.col("page_url")) if by_url else None

    def build(k: Keyed) -> DataFrame:
        k = k.add(__row=running_sum(F.lit(1).cast("long")))
        token = external_token(F.col("event_type"), F.col("product_action"), F.col("__row") == 1, page)
        k = k.cols(token=token, __is=token.isNotNull())
        if by_url:
            # the previous mapped event, whatever lies between
            k = k.cols(__mapped=F.when(F.col("__is"), F.col("token")))
            k = k.add(__before=prev_known(F.col("__mapped")))
            k = k.cols(__is=F.col("__is") & ~F.col("token").eqNullSafe(F.col("__before")))
        return k.add(__pos=running_sum(F.col("__is").cast("long"))).df

    rows = ordered(events, KEY, order, build, bounded)
    wanted = F.col("__is")
    if max_len is not None:
        wanted = wanted & (F.col("__pos") <= (max_len - 1 if by_url else max_len))
    kept = F.collect_list(F.when(wanted, F.struct("__pos", "token")))
    name = F.col(KEY[0]) if id_chars is None else F.substring(KEY[0], 1, id_chars)
    out = rows.groupBy(*KEY).agg(
        F.count_if("__is").alias("__n"), F.min(TIME).alias("start_timestamp"), F.max(TIME).alias("end_timestamp"),
        F.transform(F.array_sort(kept), lambda x: x["token"]).alias("__tokens"),
    )
    tokens = F.concat(F.array(F.lit(START)), F.col("__tokens"))
    return out.where(F.col("__n") >= min_len).select(
        F.concat(F.lit(prefix), name).alias("session_id"),
        "start_timestamp", "end_timestamp", F.size(tokens).alias("length"), tokens.alias("sequence"),
    )


# Actions, their ids after the special tokens, and the labels.
ACTION_TOKENS = {"detail": "page_view", "add": "add_to_cart", "remove": "cart_remove", "purchase": "conversion_event"}
VIEW_TOKEN = "page_browse"
TOKEN_IDS = {"page_view": 4, "page_browse": 5, "add_to_cart": 6, "cart_remove": 7, "conversion_event": 8}
LABEL_IDS = {"conversion": 0, "cart_abandon": 1, "browse_only": 2, "bounce": 3}


def labelled_sessions(
    events: DataFrame, order: list[str], min_events: int = 3, max_len: int = 8, bounded: bool = False
) -> DataFrame:
    """Token ids, gaps in seconds and mask of the last ``max_len`` events, with label and full length."""
    action = blank_to_null(F.col("product_action"))
    rows = events.withColumn("token", F.coalesce(lookup(action, ACTION_TOKENS), F.lit(VIEW_TOKEN)))

    def build(k: Keyed) -> DataFrame:
        k = k.add(pos=running_sum(F.lit(1).cast("long")), __before=lag(F.col(TIME)))
        ms = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(TIME) - F.col("__before"), F.lit(0).cast("long")))
        return k.df.withColumn("gap", F.floor(F.bround(ms / 1000, 1)).cast("int"))

    numbered_ = ordered(rows, KEY, order, build, bounded)
    totals = numbered_.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("raw_len"),
        F.coalesce(F.bool_or(action == "purchase"), F.lit(False)).alias("__bought"),
        F.coalesce(F.bool_or(action == "add"), F.lit(False)).alias("__added"),
    ).where(F.col("raw_len") >= min_events)
    last = numbered_.join(totals, on=KEY).where(F.col("pos") > F.col("raw_len") - max_len)
    item = F.struct("pos", lookup(F.col("token"), {t: str(i) for t, i in TOKEN_IDS.items()}).cast("int").alias("id"), "gap", "token")
    out = last.groupBy(*KEY, "raw_len", "__bought", "__added").agg(F.array_sort(F.collect_list(item)).alias("e"))
    fill = F.array_repeat(F.lit(0), F.lit(max_len) - F.size("e"))
    label = F.when(F.col("__bought"), "conversion").when(F.col("__added"), "cart_abandon").otherwise("browse_only")
    return out.select(
        F.col(KEY[0]).alias("session_id"),
        F.array_join(F.transform("e", lambda x: x["token"]), " ").alias("tokens"),
        F.concat(fill, F.transform("e", lambda x: x["id"])).alias("token_ids"),
        F.concat(fill, F.transform("e", lambda x: x["gap"])).alias("time_gaps"),
        F.concat(fill, F.transform("e", lambda x: F.lit(1))).alias("attn_mask"),
        label.alias("label_str"),
        lookup(label, {k: str(v) for k, v in LABEL_IDS.items()}).cast("int").alias("label_id"),
        "raw_len",
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Inverse class frequencies, the smallest scaled to 1; a handful of classes."""
    w = Window.partitionBy()
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = counts.withColumn("__w", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
    return raw.withColumn("weight", F.col("__w") / F.min("__w").over(w)).drop("__w")


def undersample(rows: DataFrame, label: str, majority: str, id_: str, factor: int = 3, seed: int = 42) -> DataFrame:
    """All minority rows and ``factor`` times as many of the majority, picked by a repeatable hash."""
    few = rows.where(F.col(label) != majority)
    n = rows.agg(F.count_if(F.col(label) != majority).alias("n")).select("n")
    many = rows.where(F.col(label) == majority).withColumn("__h", hash_of(seed, id_))
    ranked = numbered(many, ["__h", id_], "__n").where(F.col("__n") <= factor * n.scalar())
    return few.unionByName(ranked.drop("__h", "__n"))


def merge_sequences(*parts: DataFrame) -> DataFrame:
    """Real and augmented sequences as one table with the five common columns."""
    common = ["session_id", "start_timestamp", "end_timestamp", "length", "sequence"]
    out = parts[0].select(*common)
    for part in parts[1:]:
        out = out.unionByName(part.select(*common))
    return out
