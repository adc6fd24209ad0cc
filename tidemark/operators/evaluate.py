"""Evaluation of trends against topics with known courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import keyword_hits, norm
from tidemark.operators.trends import relative_weeks, terms_text

LABELS = ["growth", "drift", "decay"]

# The planted topics, their keywords and the weeks of their courses.
TOPICS = [
    ("okta", ["okta", "vpn", "mfa", "auth", "failure"], 4, 8, "growth"),
    ("data", ["snowflake", "s3", "data", "sql", "select", "getobject"], 6, None, "drift"),
    ("qualys", ["qualys", "openssl", "vuln", "vulnerability", "cve"], 9, None, "decay"),
]


def topics(spark: SparkSession, specs=TOPICS) -> DataFrame:
    return spark.createDataFrame(list(specs), "topic string, kws array<string>, from_rel long, to_rel long, gold string")


def picks(trends: DataFrame, clusters: DataFrame, specs: DataFrame) -> DataFrame:
    """topic, week, cluster_id, hits, size, pred: the best cluster by keyword hits, then size.

    Ties go to the least cluster id. Without a hit the prediction is stable.
    """
    about = clusters.select("cluster_id", norm(terms_text(clusters)).alias("terms_text"), "size")
    rows = trends.join(about, "cluster_id", "left").withColumn("text", F.concat_ws(" ", F.coalesce("terms_text", F.lit("")), norm("label")))
    both = rows.crossJoin(F.broadcast(specs))  # a handful of topics
    both = both.withColumn("hits", keyword_hits("text", F.col("kws"))).withColumn("size", F.coalesce("size", F.lit(0)))
    order = Window.partitionBy("topic", "week").orderBy(F.desc("hits"), F.desc("size"), "cluster_id")
    best = both.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select("topic", "week", "cluster_id", "hits", "size", F.when(F.col("hits") == 0, "stable").otherwise(F.col("type")).alias("pred"))


def judged(trends: DataFrame, clusters: DataFrame, specs: DataFrame) -> DataFrame:
    """topic, week, gold, pred for the weeks in which a topic has a course."""
    weeks = relative_weeks(trends)
    due = weeks.join(F.broadcast(specs), (F.col("rel") >= F.col("from_rel")) & ((F.col("rel") <= F.col("to_rel")) | F.col("to_rel").isNull()))
    return due.select("topic", "week", "gold").join(picks(trends, clusters, specs).select("topic", "week", "pred"), ["topic", "week"])


def report(pairs: DataFrame, labels: list[str] = LABELS, keys: list[str] | None = None) -> DataFrame:
    """keys, label, precision, recall, f1, support from gold and pred; 0 where undefined."""
    keys = keys or []
    each = pairs.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    gold, pred = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    n = each.groupBy(*keys, "label").agg(hit(gold & pred).alias("tp"), hit(~gold & pred).alias("fp"), hit(gold & ~pred).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return n.select(*keys, "label", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def macro_f1(pairs: DataFrame, labels: list[str] = LABELS, keys: list[str] | None = None) -> DataFrame:
    """keys, macro_f1 over all labels, absent ones included."""
    return report(pairs, labels, keys).groupBy(*(keys or [])).agg(F.avg("f1").alias("macro_f1"))
