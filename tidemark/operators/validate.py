"""Checks of raw, normalized and embedded events and of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeweek import iso_week
from tidemark.operators.trends import TYPES

REQUIRED = ["event_id", "ts", "product", "event_type", "asset_id", "msg"]


def quality(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: total_rows, total_columns, null percentages, date range, and events per ISO week."""
    base = df.agg(F.count(F.lit(1)).alias("total_rows"), *(F.round(F.avg(F.isnull(c).cast("int")) * 100, 6).alias(f"null_pct_{c}") for c in df.columns), F.min(ts).alias("start"), F.max(ts).alias("end"))
    weeks = df.groupBy(iso_week(ts).alias("w")).count().filter("w is not null").agg(F.min("count").alias("week_min"), F.max("count").alias("week_max"), F.avg("count").alias("week_mean"))
    return base.crossJoin(F.broadcast(weeks)).withColumn("total_columns", F.lit(len(df.columns)))


def duplicates(df: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: rows, distinct keys (null is one), duplicate rows; the keys are counted after a map-side distinct."""
    return df.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_keys"), (F.coalesce(F.sum("count"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"))


def vector_health(df: DataFrame, vector: str = "vector", dim: int | None = None) -> DataFrame:
    """One row: rows, null vectors, wrong dimensions, NaN and infinite elements."""
    v = F.col(vector)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v.isNull()).alias("null_vectors"),
        F.count_if(F.size(v) != dim).alias("wrong_dim") if dim is not None else F.lit(0).cast("long").alias("wrong_dim"),
        count(F.size(F.filter(v, lambda x: F.isnan(x)))).alias("nan_elements"),
        count(F.size(F.filter(v, lambda x: F.abs(x) == float("inf")))).alias("inf_elements"),
    )


def coverage(raw: DataFrame, fields: tuple[str, ...] = ("ts", "msg")) -> DataFrame:
    """One row: the percentage of rows that have each field."""
    return raw.agg(*((F.count(f) / F.count(F.lit(1)) * 100).alias(f) for f in fields))


def raw_errors(raw: DataFrame, fields: tuple[str, ...] = ("ts", "msg")) -> list[str]:
    row = coverage(raw, fields).first()
    if row[0] is None:
        return ["No events found"]
    return [f"Field '{f}' missing in {100 - row[f]:.1f}% of events" for f in fields if row[f] < 50]


def record_errors(records: DataFrame, record: str = "record", fields: tuple[str, ...] = ("ts", "msg")) -> list[str]:
    """What is wrong with raw records (a VARIANT column): none at all, some that are no objects, fields that most lack."""
    has = lambda c: F.schema_of_variant(F.try_variant_get(record, f"$['{c}']", "variant")) != "VOID"
    odd = F.coalesce(~F.schema_of_variant(record).startswith("OBJECT"), F.lit(True))
    row = records.agg(F.count(F.lit(1)).alias("_n"), F.count_if(odd).alias("_odd"), *(F.count_if(has(c)).alias(c) for c in fields)).first()
    if not row["_n"]:
        return ["No events found"]
    missing = {c: 100 - row[c] / row["_n"] * 100 for c in fields}
    return [*([f"{row['_odd']} records are no objects"] if row["_odd"] else []), *(f"Field '{c}' missing in {x:.1f}% of events" for c, x in missing.items() if x > 50)]


def normalized_errors(df: DataFrame) -> list[str]:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return [f"Missing required columns: {missing}"]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnull("event_id")).alias("id"), F.count_if(F.isnull("ts")).alias("ts")).first()
    if not row["n"]:
        return ["No events found"]
    again = duplicates(df).first()["duplicates"]
    found = ((row["id"], "null event ids"), (row["ts"], "null timestamps"), (again, "duplicate event ids"))
    return [f"{n} {what}" for n, what in found if n]


def embedding_errors(df: DataFrame, dim: int) -> list[str]:
    if "vector" not in df.columns:
        return ["Missing column: vector"]
    row = vector_health(df, "vector", dim).first()
    if not row["total"]:
        return ["No events found"]
    return [f"{row[c]} {what}" for c, what in (("null_vectors", "null vectors"), ("wrong_dim", "vectors of another dimension"), ("nan_elements", "NaN elements"), ("inf_elements", "infinite elements")) if row[c]]


def result_errors(clusters: DataFrame, trends: DataFrame, least: int = 1) -> list[str]:
    errors = [f"Missing columns in {name}: {gone}" for name, df, need in (("clusters", clusters, ["week", "cluster_id", "size", "terms"]), ("trends", trends, ["week", "type", "cluster_id", "delta_size", "drift"])) if (gone := [c for c in need if c not in df.columns])]
    if errors:
        return errors
    small = clusters.filter(F.col("size") < least).count()
    odd = sorted(r[0] for r in trends.select("type").distinct().filter(~F.col("type").isin(TYPES)).limit(20).collect())
    return [*([f"{small} clusters under {least} events"] if small else []), *([f"Invalid trend types found: {odd}"] if odd else [])]


def output_errors(spark: SparkSession, folder: str) -> list[str]:
    """What is missing or empty among a run's outputs, on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return [f"Results directory does not exist: {folder}"]
    errors = []
    for name in ("clusters_weekly.csv", "trends_summary.csv", "trends_summary.jsonl", "assignments"):
        at = path(f"{folder}/{name}")
        if not fs.exists(at):
            errors.append(f"Missing output: {name}")
        elif not fs.getContentSummary(at).getLength():
            errors.append(f"Output is empty: {name}")
    return errors
