"""Weekly counts and ingestion over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeweek import iso_week
from tidemark.sources.ingest import normalize


def normalized_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Normalized events of JSONL files as they arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return normalize(lines.select(F.try_parse_json(F.trim("value")).alias("record")))


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by ISO week and type; a week closes once the watermark has passed it.

    Weeks begin on Mondays, so windows of seven days start four days after the
    epoch's Thursday.
    """
    week = F.window("ts", "7 days", "7 days", "4 days")
    counts = events.withWatermark("ts", late).groupBy(week.alias("w"), "event_type").count()
    return counts.select(iso_week(F.col("w.start")).alias("week"), "event_type", "count")
