"""Helpers that the operators share: tables, words, shared storage."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of these six characters part words; every other character belongs to one.
GAP = r"[\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Pickle this module's functions by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where its files make fewer tasks than there are cores, its rows are spread over these."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words(text: Column | str) -> Column:
    """The words of a text in order; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI.

    It is spark.checkpoint.dir. Where that is unset and all runs on one machine
    (tests), a temporary folder is made once per session; a cluster must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)  # without a scheme it is on the default file system
    return slashes(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def slashes(uri: str) -> str:
    """file:/a as file:///a, which both Arrow and Hadoop read."""
    return "file:///" + uri[6:].lstrip("/") if uri.startswith("file:/") else uri


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, below one that goes when the session's JVM ends."""
    jvm, root = spark._jvm, f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Write the rows to the shared folder and read them back; this cuts the lineage."""
    spark, place = df.sparkSession, fresh(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*keys) if keys else writer).parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    out._place = place
    return out


def removed(spark: SparkSession, place: str) -> None:
    """Delete what lies at a place, which nothing needs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with _ord: rows that agree in the keys, which aren't null, are counted from 0.

    Rows are counted within partitions and partitions added up, so that rows
    that agree never meet, however many they are. Which of them has which
    number is not fixed, but the numbers are the same in every run.
    """
    rows = stored(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    held = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_held"))
    before = held.select(*keys, "_part", (F.sum("_held").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_held")).alias("_before"))
    within = rows.withColumn("_ord", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at")) - 1)
    return within.join(before, [*keys, "_part"]).withColumn("_ord", F.col("_before") + F.col("_ord")).drop("_part", "_at", "_before")


def filesystem(uri: str):
    """The Arrow file system of a URI and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(slashes(uri))


def row_key(docs: DataFrame) -> DataFrame:
    """_did (doc_id, null as the largest long), _th (hash of the text), and the row.

    Rows that agree in both are copies of one row for the operators. doc_id,
    text, lang and source follow; _row holds all columns, so that none of their
    names can meet one that an operator uses.
    """
    own = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), *own, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def unpacked_rows(keyed: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns of row_key()'s input again, some with new values."""
    return keyed.select(*((changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in columns))
