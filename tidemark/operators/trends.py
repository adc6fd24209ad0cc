"""Trend types of matched clusters, and views of clusters and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import contains_keyword, short_label, term_distance
from tidemark.functions.timeweek import week_sort_key
from tidemark.operators.matching import COS_THRESH, matched

TYPES = ["emergence", "stable", "drift", "growth", "decay"]


def cluster_id(week: Column | str = "week", label: Column | str = "label") -> Column:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(as_col(week).cast("string"), F.lit("_c"), as_col(label).cast("string"))


def trend_label(terms: Column | str, n: int = 4) -> Column:
    return F.array_join(F.slice(terms, 1, n), " ")


def classify(rows: DataFrame, drift_cos_drop: float = 0.2, term_jaccard_drop: float = 0.6, growth_min: int = 30) -> DataFrame:
    """matched() rows with type, drift and delta_size.

    Volume decides before drift: growth, decay, drift by cosine or by terms,
    else stable; a cluster without a match emerges.
    """
    drift = 1 - F.col("sim")
    apart = term_distance("prev_terms", "terms") >= term_jaccard_drop if "terms" in rows.columns else F.lit(False)
    kind = (
        F.when(F.col("sim").isNull(), "emergence")
        .when((F.col("size") > 1.5 * F.col("prev_size")) & (F.col("size") >= growth_min), "growth")
        .when(F.col("size") < 0.5 * F.col("prev_size"), "decay")
        .when((drift >= drift_cos_drop) | F.coalesce(apart, F.lit(False)), "drift")
        .otherwise("stable")
    )
    return rows.withColumns({"type": kind, "drift": F.coalesce(drift, F.lit(0.0)), "delta_size": F.col("size") - F.coalesce("prev_size", F.lit(0))})


def summary(clusters: DataFrame, cos_thresh: float = COS_THRESH, **rules) -> DataFrame:
    """week, type, cluster_id, delta_size, drift (3 places), label."""
    rows = classify(matched(clusters, cos_thresh), **rules)
    label = trend_label("terms") if "terms" in rows.columns else F.lit("")
    return rows.select("week", "type", cluster_id().alias("cluster_id"), F.col("delta_size").cast("long").alias("delta_size"), F.round("drift", 3).alias("drift"), label.alias("label"))


def pivot(trends: DataFrame) -> DataFrame:
    """How many trends of each type a week has."""
    return trends.groupBy("week").pivot("type", TYPES).count().fillna(0, TYPES)


def as_of(trends: DataFrame, week: str, types: list[str] | None = None) -> DataFrame:
    """Trends up to a week, of some types, in (week, type) order."""
    rows = trends.filter(F.col("week") <= week)
    return (rows.filter(F.col("type").isin(types)) if types is not None else rows).orderBy("week", "type", "cluster_id")


def tail(trends: DataFrame, n: int = 10) -> DataFrame:
    """The last n trends in (week, cluster) order, last first."""
    return trends.orderBy(F.desc(week_sort_key("week")), F.desc("cluster_id")).limit(n)


def of_week(clusters: DataFrame, week: str) -> DataFrame:
    return clusters.filter(F.col("week") == week).orderBy(F.desc("size"), "cluster_id")


def keyword_counts(clusters: DataFrame, keywords: list[str]) -> DataFrame:
    """week and, per keyword, the clusters whose terms contain it."""
    text = terms_text(clusters)
    return clusters.groupBy("week").agg(*(F.count_if(contains_keyword(text, k)).alias(k) for k in keywords))


def keyword_sizes(clusters: DataFrame, keyword: str) -> DataFrame:
    """week, size: the summed sizes of the clusters whose terms contain a keyword."""
    return clusters.groupBy("week").agg(F.sum(F.when(contains_keyword(terms_text(clusters), keyword), F.col("size")).otherwise(0)).alias("size"))


def snapshot(clusters: DataFrame) -> DataFrame:
    """The last week's clusters with short labels, largest first."""
    keyed = clusters.withColumn("_key", week_sort_key("week"))
    last = keyed.agg(F.max_by("week", F.struct("_key", "week")).alias("week"))
    return clusters.join(last, "week", "left_semi").select("week", "cluster_id", short_label(terms_text(clusters)).alias("short"), "size").orderBy(F.desc("size"), "cluster_id")


def terms_text(clusters: DataFrame) -> Column:
    """Terms as text, whether they are an array or were read from CSV."""
    return F.col("terms") if dict(clusters.dtypes)["terms"] == "string" else F.concat_ws(" ", "terms")


def kept_weeks(events: DataFrame, least: int = 5) -> DataFrame:
    """Events of the weeks that have enough of them; the week counts are combined before a shuffle."""
    enough = events.groupBy("week").count().filter(F.col("count") >= least)
    return events.join(enough, "week", "left_semi")


def relative_weeks(trends: DataFrame) -> DataFrame:
    """week, rel: each week's place in the sorted weeks, from 0."""
    weeks = trends.select("week").distinct()
    return weeks.withColumn("rel", (F.row_number().over(Window.orderBy(week_sort_key("week"), "week")) - 1).cast("long"))
