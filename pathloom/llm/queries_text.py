"""Queries that look at every document's whole text on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.llm import bpe, packing, pii, quality
from pathloom.llm.common import table
from pathloom.llm.registry import query


@query("op8_compression_bands")
def compression_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, bands=quality.fit_bands(docs, table(spark, sf_dir, "labels")))


@query("op6_bpe_trie")
def bpe_trie(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op7_cost_packing")
def cost_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op2_pii_crf")
def pii_crf(spark, sf_dir):
    found = pii.detect(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
