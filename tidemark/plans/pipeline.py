"""The stages of a run: ingest, embed, cluster, evaluate, dashboard."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeweek import iso_week
from tidemark.operators import clusters, encode, evaluate, kmeans, retrieval, trends, validate
from tidemark.plans.config import Config
from tidemark.plans.log import ClusteringError, EmbeddingError, IngestionError, PipelineError, logger, timed
from tidemark.sources import ingest, sinks

# The evaluation queries, their keywords and the swept alphas.
QUERIES = [
    ("investigation of recent Okta MFA authentication failures", ["okta", "mfa", "vpn"]),
    ("summary of data access patterns involving Snowflake and S3", ["snowflake", "select", "sql", "s3"]),
    ("latest Qualys findings related to OpenSSL vulnerabilities", ["qualys", "openssl", "vuln", "vulnerability"]),
]
LOGON_QUERIES = [("recent workstation logon events", ["logon", "pc", "workstation"]), ("recent workstation logoff events", ["logoff", "pc", "workstation"])]
ALPHAS = [0.4, 0.5, 0.7, 0.9, 0.95]


def checked(errors: list[str], error: type[Exception], fatal: bool) -> None:
    for e in errors:
        logger().warning(e)
    if errors and fatal:
        raise error("; ".join(errors))


def made_by(spark: SparkSession, stage: str, path: str, error: type[Exception]) -> DataFrame:
    """The table that an earlier stage has written; without it, an error that names the stage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise error(f"{path} is missing: run the stage {stage} first")
    return spark.read.parquet(path)


@timed
def run_ingest(spark: SparkSession, cfg: Config, strict: bool = False) -> DataFrame:
    sinks.write_parquet(ingest.read_logs(spark, cfg.paths.logs), cfg.paths.events, by_ts=True)
    events = spark.read.parquet(cfg.paths.events)
    checked(validate.normalized_errors(events), IngestionError, strict)
    return events


@timed
def run_embed(spark: SparkSession, cfg: Config, strict: bool = False) -> DataFrame:
    events = made_by(spark, "ingest", cfg.paths.events, EmbeddingError)
    sinks.write_parquet(encode.embed(events, cfg.model.dimension, cfg.model.dtype), cfg.paths.embedded)
    out = spark.read.parquet(cfg.paths.embedded)
    checked(validate.embedding_errors(out, cfg.model.dimension), EmbeddingError, strict)
    return out


def cluster(events: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled events, cluster rows and trends of embedded events."""
    c = cfg.clustering
    weekly = events.withColumn("week", iso_week("ts"))
    k: int | dict[str, int] = c.default_k
    if c.auto_k and c.k_rule == "elbow":
        k = {r["week"]: r["k"] for r in kmeans.elbow_picks(kmeans.elbow_table(weekly, c.k_min, c.k_max, c.min_events_per_week)).collect()}
    elif c.auto_k:
        k = kmeans.pick_by_silhouette(weekly, c.k_min, c.k_max, c.min_events_per_week)
    least = c.min_events_per_week if c.auto_k else max(c.min_events_per_week, c.default_k)
    labelled = kmeans.cluster_weeks(weekly, k, least).withColumn("cluster_id", trends.cluster_id())
    rows = clusters.cluster_rows(labelled, cfg.model.dimension)
    found = trends.summary(rows, c.cos_thresh, drift_cos_drop=c.drift_cos_drop, term_jaccard_drop=c.term_jaccard_drop, growth_min=c.emerge_min)
    return labelled, rows, found


@timed
def run_cluster(spark: SparkSession, cfg: Config, strict: bool = False) -> None:
    out = cfg.paths.results
    labelled, rows, _ = cluster(made_by(spark, "embed", cfg.paths.embedded, ClusteringError), cfg)
    sinks.write_assignments(labelled, f"{out}/assignments")
    sinks.write_parquet(rows, f"{out}/clusters.parquet")
    rows = spark.read.parquet(f"{out}/clusters.parquet")
    c = cfg.clustering
    found = trends.summary(rows, c.cos_thresh, drift_cos_drop=c.drift_cos_drop, term_jaccard_drop=c.term_jaccard_drop, growth_min=c.emerge_min)
    sinks.write_csv(rows.select("week", "cluster_id", "size", "terms").orderBy("week", "cluster_id"), f"{out}/clusters_weekly.csv")
    sinks.write_csv(found.orderBy("week", "cluster_id"), f"{out}/trends_summary.csv")
    sinks.write_jsonl(found.orderBy("week", "cluster_id"), f"{out}/trends_summary.jsonl")
    checked(validate.result_errors(rows, found) + validate.output_errors(spark, out), ClusteringError, strict)


def query_table(spark: SparkSession, queries, dim: int) -> DataFrame:
    return spark.createDataFrame([(q, encode.query_vector(q, dim), kws) for q, kws in queries], "query string, qvec array<double>, kws array<string>")


@timed
def run_evaluate(spark: SparkSession, cfg: Config, strict: bool = False) -> dict[str, DataFrame]:
    """latest_at_k and trend F1 of the results, written as CSV."""
    out, t = cfg.paths.results, cfg.time_aware
    events = made_by(spark, "embed", cfg.paths.embedded, PipelineError)
    rows, found = made_by(spark, "cluster", f"{out}/clusters.parquet", PipelineError), sinks.read_trends_csv(spark, f"{out}/trends_summary.csv")
    sweep = retrieval.latest_at_k(events, query_table(spark, QUERIES, cfg.model.dimension), 10, ALPHAS, t.half_life_days)
    logon = retrieval.latest_at_k(events, query_table(spark, LOGON_QUERIES, cfg.model.dimension), 10, ALPHAS, 3.0, within=True)
    judged = evaluate.judged(found, rows, evaluate.topics(spark))
    tables = {"alpha_sensitivity_synth": sweep, "alpha_sensitivity_logon": logon, "trend_f1": evaluate.report(judged), "trend_macro_f1": evaluate.macro_f1(judged), "trend_topic_f1": evaluate.macro_f1(judged, keys=["topic"]), "topic_timeline": trends.keyword_counts(rows, ["logon", "logoff"])}
    for name, df in tables.items():
        sinks.write_csv(df, f"{out}/{name}.csv")
    return tables


def dashboard(spark: SparkSession, cfg: Config, week: str | None = None, types: list[str] | None = None) -> dict[str, DataFrame]:
    """The three views of a chosen week: trends up to it, its clusters, trend counts."""
    rows = made_by(spark, "cluster", f"{cfg.paths.results}/clusters.parquet", PipelineError)
    found = sinks.read_trends_csv(spark, f"{cfg.paths.results}/trends_summary.csv")
    week = week or rows.agg(F.max("week")).first()[0]
    return {"trends": trends.as_of(found, week, types), "clusters": trends.of_week(rows, week), "counts": trends.pivot(found)}


@timed
def run_dashboard(spark: SparkSession, cfg: Config, strict: bool = False) -> dict[str, DataFrame]:
    """The views of the last week, written as CSV."""
    views = dashboard(spark, cfg)
    for name, df in views.items():
        sinks.write_csv(df, f"{cfg.paths.results}/dashboard/{name}.csv")
    return views


STAGES = {"ingest": run_ingest, "embed": run_embed, "cluster": run_cluster, "evaluate": run_evaluate, "dashboard": run_dashboard}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run the stages of the log-trend pipeline.")
    parser.add_argument("--stage", default="all", choices=[*STAGES, "all"])
    parser.add_argument("--config", default="config.yaml")
    parser.add_argument("--root")
    parser.add_argument("--k", type=int)
    parser.add_argument("--auto-k", choices=["silhouette", "elbow"])
    parser.add_argument("--strict", action="store_true", help="stop at validation errors")
    given = parser.parse_args(args)
    cfg = Config.from_yaml(given.config)
    if given.root:
        cfg.paths.root = given.root
    if given.k:
        cfg.clustering.default_k = given.k
    if given.auto_k:
        cfg.clustering.auto_k, cfg.clustering.k_rule = True, given.auto_k
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, stage in STAGES.items():
        if given.stage in ("all", name):
            stage(spark, cfg, given.strict)


if __name__ == "__main__":
    main()
