"""Raw JSONL and CSV logs, normalized to the event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import stable_id
from tidemark.schema import EVENTS

# The names under which a field may come, in order of preference.
ALIASES = {
    "ts": ["ts", "@timestamp", "time", "timestamp"],
    "product": ["product", "source", "vendor"],
    "event_type": ["event_type", "type", "action"],
    "asset_id": ["asset_id", "host", "dst_host", "device"],
    "msg": ["msg", "message"],
    "context": ["context"],
    "tech": ["tech"],
    "attack": ["attack", "attack_techniques"],
    "risk_tag": ["risk_tag", "tags"],
    "event_id": ["event_id", "id", "_id"],
}

#: Formats of timestamp strings, besides those that a cast to timestamp reads.
TS_FORMATS = ["yyyyMMdd", "yyyyMMdd'T'HHmmssX", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd/MMM/yyyy:HH:mm:ss Z", "dd MMM yyyy HH:mm:ss Z", "MM/dd/yyyy HH:mm:ss"]


class Field:
    """A VARIANT value with its JSON kind, as two columns."""

    def __init__(self, value: Column, kind: Column):
        self.value, self.kind = value, kind

    def is_(self, *kinds: str) -> Column:
        out = F.lit(False)
        for k in kinds:
            out = out | self.kind.startswith(k)
        return F.coalesce(out, F.lit(False))

    @property
    def number(self) -> Column:
        return self.is_("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")

    @property
    def text(self) -> Column:
        """As printed: true and false begin with a capital, arrays and objects are JSON."""
        plain = F.try_variant_get(self.value, "$", "string")
        return F.when(self.is_("BOOLEAN"), F.initcap(plain)).when(self.is_("ARRAY", "OBJECT"), F.to_json(self.value)).otherwise(plain)

    @property
    def truthy(self) -> Column:
        """False for null, '', 0, false, [] and {}."""
        plain = F.to_json(self.value)
        return self.kind.isNotNull() & (self.kind != "VOID") & ~plain.isin('""', "false", "[]", "{}") & ~(self.number & (F.try_variant_get(self.value, "$", "double") == 0))


def of(record: str, field: str, made) -> Column:
    """made(Field) of the first alias of a field that counts as given, else null.

    The record and the Field are bound to variables of lambdas, so that each is
    found once however often it is used, also where a filter on the result is
    pushed below the projection that parses records.
    """

    def chosen(r: Column) -> Column:
        values = F.transform(F.array(*(F.try_variant_get(r, f"$['{k}']", "variant") for k in ALIASES[field])), lambda v: F.struct(v.alias("value"), F.schema_of_variant(v).alias("kind")))
        return F.get(F.filter(values, lambda f: Field(f["value"], f["kind"]).truthy), 0)

    found = F.filter(F.transform(F.array(record), chosen), lambda f: f.isNotNull())
    return F.get(F.transform(found, lambda f: made(Field(f["value"], f["kind"]))), 0)


def timestamp_of(f: Field) -> Column:
    """Numbers over 1e12 are milliseconds, others seconds since 1970; strings are parsed, else null."""
    n = F.when(f.is_("BOOLEAN"), F.try_variant_get(f.value, "$", "boolean").cast("double")).otherwise(F.try_variant_get(f.value, "$", "double"))
    epoch = F.timestamp_micros(F.round(F.when(n > 1e12, n * 1e3).otherwise(n * 1e6)).cast("long"))
    text = F.try_variant_get(f.value, "$", "string")
    plain = F.regexp_replace(text, "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
    parsed = F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(plain, F.lit(x)) for x in TS_FORMATS))
    return F.when(f.number | f.is_("BOOLEAN"), epoch).when(f.is_("STRING"), parsed)


def list_of(f: Field) -> Column:
    """An array as it is, anything else as its only element."""
    return F.when(f.is_("ARRAY"), F.try_variant_get(f.value, "$", "array<string>")).otherwise(F.array(f.text))


def context_of(f: Field) -> Column:
    """Objects and arrays as JSON, anything else under the key raw."""
    return F.when(f.is_("OBJECT", "ARRAY"), F.to_json(f.value)).otherwise(F.to_json(F.struct(f.text.alias("raw"))))


def ts_text(ts: Column) -> Column:
    """2025-04-01 00:00:00+00:00, with a fraction only if there is one."""
    micro = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit("+00:00"))


def normalize(records: DataFrame, record: str = "record", keep_undated: bool = False) -> DataFrame:
    """The event schema from a VARIANT column of objects; other rows are dropped.

    Missing names are `unknown`, a missing message is empty, missing lists are
    empty, a missing context is {}. Events without a readable ts are dropped
    unless keep_undated. An event without an id gets a stable hash of its
    fields. Duplicate ids stay.
    """
    text = lambda field, default: F.coalesce(of(record, field, lambda f: f.text), F.lit(default))
    # what isn't an object has no ts
    objects = records.filter(F.schema_of_variant(record).startswith("OBJECT")) if keep_undated else records
    fields = F.struct(
        of(record, "ts", timestamp_of).alias("ts"),
        *(text(c, "unknown").alias(c) for c in ("product", "event_type", "asset_id")),
        text("msg", "").alias("msg"),
        F.coalesce(of(record, "context", context_of), F.lit("{}")).alias("context"),
        *(F.coalesce(of(record, c, list_of), F.array().cast("array<string>")).alias(c) for c in ("tech", "attack", "risk_tag")),
        of(record, "event_id", lambda f: f.text).alias("given"),
    )
    # rows come out of a generator, so that the filter isn't pushed below the parsing, which would be done twice
    made = F.filter(F.array(fields), lambda e: F.lit(keep_undated) | e["ts"].isNotNull())
    rows = objects.select(F.inline(made))
    made = stable_id(ts_text(F.col("ts")), F.col("product"), F.col("event_type"), F.col("asset_id"), F.col("msg"))
    return rows.withColumn("event_id", F.coalesce("given", made)).select(*EVENTS.names)


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record: a VARIANT per line that may be an object; null where it isn't JSON."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value").startswith("{"))
    return lines.select(F.try_parse_json("value").alias("record"))


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record: an object per row of files with a header; blank cells are absent, numbers are numbers."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    number = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), r'^\{"v":(.*)\}$', "$1")
    cells = [F.when(F.length(F.col(f"`{c}`")) > 0, F.concat(F.lit('"' + c.replace("\\", "\\\\").replace('"', '\\"') + '":'), F.when(F.col(f"`{c}`").rlike(number), F.col(f"`{c}`")).otherwise(quoted(c)))) for c in rows.columns]
    return rows.select(F.try_parse_json(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))).alias("record"))


def read_logs(spark: SparkSession, folder: str, dedup: bool = False) -> DataFrame:
    """All *.jsonl and *.csv of a folder, normalized."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for pattern, read in (("*.jsonl", read_jsonl), ("*.csv", read_csv)):
        if fs.exists(path(folder)) and len(fs.globStatus(path(f"{folder}/{pattern}")) or []):
            parts.append(normalize(read(spark, f"{folder}/{pattern}")))
    if not parts:
        raise FileNotFoundError(f"no *.jsonl or *.csv in {folder}")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.dropDuplicates(["event_id"]) if dedup else rows
