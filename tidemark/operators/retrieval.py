"""Time-aware retrieval: top-k by fused similarity and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import contains_any
from tidemark.functions.timeweek import fused, iso_week_number, micros, recency
from tidemark.functions.vectors import dot

#: Queries are a caller's few rows; more than this many are joined without a broadcast.
BROADCAST_QUERIES = 10_000


def scored(events: DataFrame, queries: DataFrame, alpha: float = 0.7, half_life_days: float = 14.0, now=None) -> DataFrame:
    """Each event with each query: columns of both, sim, recent and score.

    events: event_id, ts, vector, text_repr if queries have keywords. queries:
    query, qvec. now is a literal or the last ts of the events, from a one-row
    aggregate.
    """
    now_ = F.lit(now).cast("timestamp") if now is not None else F.col("_now")
    rows = events if now is not None else events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("_now"))))
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    both = rows.crossJoin(F.broadcast(queries) if few else queries)
    both = both.withColumns({"sim": dot("vector", "qvec"), "recent": recency("ts", now_, half_life_days)})
    return both.withColumn("score", fused(F.col("sim"), F.col("recent"), alpha)).drop("_now")


def top_k(scores: DataFrame, k: int = 10, by: str = "score", keys: list[str] | None = None) -> DataFrame:
    """The k best rows of each query with their rank; ties by event_id."""
    order = Window.partitionBy(*(keys or ["query"])).orderBy(F.desc(by), "event_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fused_topk(events: DataFrame, queries: DataFrame, k: int = 10, alpha: float = 0.7, half_life_days: float = 14.0, now=None) -> DataFrame:
    return top_k(scored(events, queries, alpha, half_life_days, now), k)


def asof_topk(events: DataFrame, queries: DataFrame, week: int, k: int = 10, alpha: float = 0.7, half_life_days: float = 14.0, now=None) -> DataFrame:
    """top k among the events up to an ISO week (year * 100 + week); recency counts from their last."""
    return fused_topk(events.filter(iso_week_number("ts") <= week), queries, k, alpha, half_life_days, now)


def latest_at_k(events: DataFrame, queries: DataFrame, k: int = 10, alphas: list[float] | None = None, half_life_days: float = 14.0, within: bool = False) -> DataFrame:
    """alpha, queries, cosine_score, fused_score, improvement.

    The share of queries whose newest relevant event is among the k best by
    cosine, and by fused score. queries: query, qvec, kws; an event is relevant
    if its text contains a keyword; queries without relevant events are left
    out. within ranks relevant events only, else all are ranked. All alphas are
    judged in one pass over the events. The newest event's ties go to the
    least event_id.
    """
    alphas = alphas or [0.7]
    rows = scored(events, queries, 1.0, half_life_days).withColumn("relevant", contains_any("text_repr", F.col("kws")))
    newest = rows.filter("relevant").groupBy("query").agg(F.min_by("event_id", F.struct((-micros(F.col("ts"))).alias("t"), "event_id")).alias("newest"))
    rows = (rows.filter("relevant") if within else rows).select("query", "event_id", "sim", "recent")
    judged = rows.withColumn("alpha", F.explode(F.array(*map(F.lit, [1.0, *(a for a in alphas if a != 1.0)]))))
    judged = judged.withColumn("score", fused(F.col("sim"), F.col("recent"), F.col("alpha")))
    best = top_k(judged, k, "score", ["query", "alpha"]).select("query", "alpha", "event_id")
    wins = newest.crossJoin(F.broadcast(events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, dict.fromkeys([1.0, *alphas])))).alias("alpha")).select("alpha")))
    hit = wins.join(best.withColumnRenamed("event_id", "newest").withColumn("hit", F.lit(1.0)), ["query", "alpha", "newest"], "left")
    per = hit.groupBy("alpha").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("s"))
    plain = per.filter("alpha = 1.0").select(F.col("s").alias("cosine_score"))
    return per.filter(F.col("alpha").isin(alphas)).crossJoin(F.broadcast(plain)).select("alpha", "queries", "cosine_score", F.col("s").alias("fused_score"), (F.col("s") - F.col("cosine_score")).alias("improvement"))


def rerank(events: DataFrame, queries: DataFrame, k: int = 10, alpha: float = 0.7, half_life_days: float = 14.0) -> DataFrame:
    """The k best by cosine with their fused scores and fused ranks."""
    best = top_k(scored(events, queries, alpha, half_life_days), k, "sim")
    return best.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "event_id")))


def asof_violations(found: DataFrame, week: int) -> DataFrame:
    return found.agg(F.coalesce(F.bool_or(iso_week_number("ts") > week), F.lit(False)).alias("violated"))


def median_week(events: DataFrame) -> DataFrame:
    """One row, week: the median of the distinct ISO weeks."""
    return events.select(iso_week_number("ts").alias("w")).distinct().agg(F.median("w").cast("long").alias("week"))
