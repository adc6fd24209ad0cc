"""Synthetic logs with three planted courses: growth, drift and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Twelve weeks from 2025-04-01 and the patterns' volumes and fields.
START, WEEKS = "2025-04-01 00:00:00", 12


def _pick(values: list, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def random_ip(seed: int = 42) -> Column:
    return F.concat_ws(".", *(F.floor(F.rand(seed + i) * 254 + 1).cast("string") for i in range(4)))


def sample_logs(spark: SparkSession, seed: int = 42) -> DataFrame:
    """Raw records of about 75 events a week, as rows that read like JSONL objects."""
    weeks = spark.range(WEEKS).select(F.col("id").alias("w"))

    def pattern(letter: str, volume: Column, jitter: int, s: int, **fields: Column) -> DataFrame:
        n = F.greatest(F.lit(5), volume + F.floor(F.rand(s) * (2 * jitter + 1)) - jitter).cast("int")
        rows = weeks.select("w", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
        minutes = F.floor(F.rand(s + 1) * 10081)
        ts = F.to_timestamp(F.lit(START)) + F.make_dt_interval(F.col("w") * 7, F.lit(0), minutes)
        return rows.select(F.format_string(letter + "-%d-%d", "w", "i").alias("event_id"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"), *(c.alias(k) for k, c in fields.items()))

    w, lits = F.col("w"), lambda *x: F.array(*map(F.lit, x))
    late = w >= 6
    a = pattern("A", F.when(w.between(4, 8), 30).otherwise(20), 3, seed, product=F.lit("okta"), event_type=F.lit("auth.failure"), asset_id=F.lit("vpn-1"), msg=F.lit("MFA denied"),
                context=F.to_json(F.struct(_pick(["US-CA", "US-NY", "CN", "DE"], seed + 2).alias("geo"), F.lit("push").alias("method"))), tech=lits("okta", "vpn", "mfa"), attack=lits("TA0006:T1110"), risk_tag=lits("identity"))
    b = pattern("B", F.lit(25), 5, seed + 10, product=F.when(late, "snowflake").otherwise("aws"), event_type=F.lit("data.access"), asset_id=_pick(["etl-1", "etl-2", "bi-1"], seed + 12),
                msg=F.when(late, "Snowflake SELECT large result set").otherwise("S3 GetObject request"), context=F.to_json(F.struct(_pick(["us-east-1", "us-west-2", "eu-central-1"], seed + 13).alias("region"))),
                tech=F.when(late, lits("snowflake", "sql")).otherwise(lits("aws", "s3")), attack=lits("TA0010:T1020"), risk_tag=lits("exfiltration"))
    c = pattern("C", F.when(w < 9, 30).otherwise(10), 3, seed + 20, product=F.lit("qualys"), event_type=F.lit("vuln.finding"), asset_id=_pick(["web-1", "db-2", "api-3"], seed + 22), msg=F.lit("OpenSSL CVE found"),
                context=F.to_json(F.struct(_pick([6.5, 7.2, 8.1, 9.8], seed + 23).alias("cvss"))), tech=lits("openssl", "linux"), attack=F.array().cast("array<string>"), risk_tag=lits("vulnerability"))
    return a.unionByName(b).unionByName(c)


def write_sample_logs(spark: SparkSession, path: str, seed: int = 42) -> None:
    rows = sample_logs(spark, seed)
    text = F.regexp_replace(F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != "context"))), r"\}$", "")
    rows.select(F.concat(text, F.lit(',"context":'), "context", F.lit("}"))).coalesce(1).write.mode("overwrite").text(path)
