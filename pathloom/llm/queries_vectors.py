"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.llm import nearest
from pathloom.llm.common import table
from pathloom.llm.registry import query


@query("op9_kmeans_tree")
def kmeans_tree(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
