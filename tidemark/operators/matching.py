"""Matching the clusters of consecutive kept weeks, one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine

COS_THRESH = 0.5


def week_ranks(clusters: DataFrame, week: str = "week") -> DataFrame:
    """week, rank: consecutive numbers of the weeks that have clusters.

    One row per week meets in one task, after a distinct.
    """
    return clusters.select(week).distinct().withColumn("rank", F.row_number().over(Window.orderBy(week)))


def pairs(clusters: DataFrame, cos_thresh: float = COS_THRESH) -> DataFrame:
    """Current and previous clusters with a cosine of at least the threshold.

    clusters: week, label, size, centroid, optionally terms. The previous week
    is the last one that was kept, so that a skipped week is passed over.
    """
    ranks = week_ranks(clusters)
    ranked = clusters.join(F.broadcast(ranks), "week")  # a row for each week of the calendar
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("week").alias("prev_week"), F.col("label").alias("prev_label"), F.col("centroid").alias("prev_centroid"))
    both = ranked.select("rank", "week", "label", "centroid").join(before, "rank")
    return both.withColumn("sim", cosine("centroid", "prev_centroid")).filter(F.col("sim") >= cos_thresh).select("week", "label", "prev_week", "prev_label", "sim")


def greedy(candidates: DataFrame) -> DataFrame:
    """week, label, prev_week, prev_label, sim: the greedy one-to-one assignment.

    Pairs are taken by descending similarity, then label, then previous label,
    unless either side is taken. A week's candidates are at most the product
    of two weeks' cluster counts.
    """
    ordered = candidates.groupBy("week", "prev_week").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), "label", "prev_label"))).alias("c"))
    taken = lambda acc, x: F.exists(acc, lambda y: (y["label"] == x["label"]) | (y["prev_label"] == x["prev_label"]))
    fold = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return ordered.select("week", "prev_week", F.explode(fold).alias("m")).select("week", F.col("m.label").alias("label"), "prev_week", F.col("m.prev_label").alias("prev_label"), (-F.col("m.d")).alias("sim"))


def matched(clusters: DataFrame, cos_thresh: float = COS_THRESH) -> DataFrame:
    """clusters with prev_week, prev_label, prev_size, prev_terms and sim; null if unmatched."""
    found = greedy(pairs(clusters, cos_thresh))
    old = clusters.select(F.col("week").alias("prev_week"), F.col("label").alias("prev_label"), F.col("size").alias("prev_size"), *([F.col("terms").alias("prev_terms")] if "terms" in clusters.columns else []))
    return clusters.join(found, ["week", "label"], "left").join(old, ["prev_week", "prev_label"], "left")
