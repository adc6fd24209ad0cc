"""Weekly cluster rows from labelled events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import top_terms
from tidemark.functions.vectors import centroids
from tidemark.operators.trends import cluster_id


def cluster_rows(labelled: DataFrame, dim: int, text: str = "text_repr", n_terms: int = 6) -> DataFrame:
    """week, cluster_id, label, size, terms, centroid."""
    base = centroids(labelled, ["week", "label"], "vector", dim)
    terms = top_terms(labelled, ["week", "label"], text, n_terms)
    rows = base.join(terms, ["week", "label"], "left")
    return rows.select("week", cluster_id().alias("cluster_id"), F.col("label").cast("int").alias("label"), "size", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "centroid")
