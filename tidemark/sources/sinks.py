"""Writing results, and reading published ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import ASSIGNMENT_COLUMNS, CLUSTERS_CSV, TRENDS


def write_parquet(df: DataFrame, path: str, by_ts: bool = False) -> None:
    """zstd Parquet; by_ts ranges rows by time, so that row groups can be skipped."""
    rows = df.repartitionByRange("ts").sortWithinPartitions("ts") if by_ts else df
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_assignments(df: DataFrame, path: str) -> None:
    """One folder a week; of the assignment columns those that exist."""
    df.select("week", *(c for c in ASSIGNMENT_COLUMNS if c in df.columns)).write.mode("overwrite").partitionBy("week").option("compression", "zstd").parquet(path)


def list_text(array: Column | str) -> Column:
    """An array of strings in the form ['a', 'b']."""
    array = F.col(array) if isinstance(array, str) else array
    return F.concat(F.lit("["), F.array_join(F.transform(array, lambda t: F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))), ", "), F.lit("]"))


def parse_list(text: Column | str) -> Column:
    """The strings of ['a', 'b']."""
    text = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(text, F.lit(r"'((?:[^'\\]|\\.)*)'"), F.lit(1)), lambda t: F.regexp_replace(t, r"\\(.)", "$1"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the driver and all executors share (spark.checkpoint.dir).

    Where that is unset and all runs on one machine, a temporary one. It goes when the session's JVM ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    place = f"{found or 'file://' + tempfile.gettempdir()}/tidemark-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return place


def write_lines(df: DataFrame, path: str) -> None:
    """JSONL logs, in as many files as there are tasks."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV logs with headers, in as many files as there are tasks."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays as list text. Results are a few rows a week, so one file."""
    flat = df.select(*(list_text(c).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes if t != "array<double>"))
    flat.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_clusters_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CLUSTERS_CSV).option("header", True).option("escape", '"').csv(path)
    return rows.withColumn("terms", parse_list("terms"))


def read_trends_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRENDS).option("header", True).option("escape", '"').csv(path)
