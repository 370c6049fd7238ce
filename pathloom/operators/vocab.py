"""Vocabularies and fixed-length encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.ordered import numbered
from pathloom.operators.sessions import SESSION
from pathloom.session import cut

# The order of the special tokens differs between tools, so it is a parameter.
LAYOUTS = {
    "default": ["[PAD]", "[UNK]", "[CLS]", "[MASK]"],
    "cls_first": ["[PAD]", "[CLS]", "[MASK]", "[UNK]"],
    "mask_before_cls": ["[PAD]", "[UNK]", "[MASK]", "[CLS]"],
    "no_cls": ["[PAD]", "[UNK]", "[MASK]"],
}


def special_ids(layout: str = "default") -> dict[str, int]:
    return {name: i for i, name in enumerate(LAYOUTS[layout])}


def token_frequencies(long: DataFrame) -> DataFrame:
    return long.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def build_vocab(long: DataFrame, layout: str = "default", min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """(token, id, freq): special tokens first, then by frequency, equal ones by name."""
    special = special_ids(layout)
    counts = token_frequencies(long).where((F.col("freq") >= min_freq) & ~F.col("token").isin(list(special)))
    # counting and numbering both read the counts, the sequences are read once
    ranked = numbered(cut(counts.withColumn("__rare", -F.col("freq"))), ["__rare", "token"], "__n")
    words = ranked.select("token", (F.col("__n") + len(special) - 1).cast("int").alias("id"), "freq")
    if max_size is not None:
        words = words.where(F.col("id") < max_size)
    fixed = long.sparkSession.createDataFrame([(t, i) for t, i in special.items()], "token string, id int")
    return fixed.withColumn("freq", F.lit(None).cast("long")).unionByName(words)


def encode_tokens(long: DataFrame, vocab: DataFrame, unk: int = 1) -> DataFrame:
    """Add ``token_id``; tokens outside the vocabulary get ``unk``.

    No broadcast is forced: a small vocabulary is broadcast by its measured size, a large one is
    joined by token, where a frequent token is split as a skewed partition.
    """
    return long.join(vocab.select("token", F.col("id").alias("token_id")), on="token", how="left").withColumn(
        "token_id", F.coalesce("token_id", F.lit(unk))
    )


def _listed(keep: Column, pos: Column, value: Column) -> Column:
    """Values of the kept rows in order; rows not kept are never collected."""
    pairs = F.collect_list(F.when(keep, F.struct(pos.alias("i"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def _with_length(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return long.join(n, on=list(keys))


def encode_sequences(
    long: DataFrame, vocab: DataFrame, max_len: int, keys: Sequence[str] = SESSION, layout: str = "default",
    use_cls: bool = True, truncate: str = "right", pad: bool = True,
) -> DataFrame:
    """Token ids of fixed length with attention mask, the start (``right``) or the end (``left``) kept.

    Only kept positions are collected, at most ``max_len`` per sequence.
    """
    special = special_ids(layout)
    room = max_len - (1 if use_cls else 0)
    ids = encode_tokens(long, vocab, special["[UNK]"])
    if truncate == "left":
        ids = _with_length(ids, keys)
        keep = F.col("pos") > F.col("__n") - room
    else:
        keep = F.col("pos") <= room
    out = ids.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("original_length"), _listed(keep, F.col("pos"), F.col("token_id")).alias("__ids")
    )
    head = F.array(F.lit(special["[CLS]"])) if use_cls else F.array().cast("array<int>")
    used = F.concat(head, F.col("__ids"))
    gap = F.lit(max_len) - F.size(used) if pad else F.lit(0)
    return out.select(
        *keys,
        "original_length",
        F.size(used).alias("used_length"),
        F.concat(used, F.array_repeat(F.lit(special["[PAD]"]), gap)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(used)), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )


def left_padded(long: DataFrame, value: str, max_len: int, keys: Sequence[str] = SESSION, pad: int = 0) -> DataFrame:
    """The last ``max_len`` values, padded on the left."""
    rows = _with_length(long, keys)
    kept = _listed(F.col("pos") > F.col("__n") - max_len, F.col("pos"), F.col(value))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_len"), kept.alias("__kept"))
    fill = F.array_repeat(F.lit(pad).cast(long.schema[value].dataType), F.lit(max_len) - F.size("__kept"))
    return out.select(*keys, "raw_len", F.concat(fill, F.col("__kept")).alias("values"))


def hash_of(seed: int, *columns: str) -> Column:
    """A repeatable random number per row, 0 to 2³²−1."""
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in columns), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mask_tokens(
    encoded_long: DataFrame, keys: Sequence[str] = SESSION, percent: int = 15, seed: int = 42, layout: str = "default"
) -> DataFrame:
    """Training pairs in long form: a share of the positions is masked; the label is the id there, else −100."""
    special = special_ids(layout)
    fixed = [special[t] for t in ("[PAD]", "[CLS]") if t in special]
    chosen = ~F.col("token_id").isin(fixed) & (hash_of(seed, *keys, "pos") % 100 < percent)
    return encoded_long.select(
        *keys, "pos",
        F.when(chosen, F.lit(special["[MASK]"])).otherwise(F.col("token_id")).alias("masked_id"),
        F.when(chosen, F.col("token_id")).otherwise(F.lit(-100)).alias("label"),
    )
