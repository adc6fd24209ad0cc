"""Ingestion of odd records, sinks, the generator, and a stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import generator, ingest, sinks
from tidemark.streaming import weekly

UTC = dt.timezone.utc


def normalized(spark, records, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records), encoding="utf-8")
    return ingest.normalize(ingest.read_jsonl(spark, f"file://{path}"))


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({"ts": 1743465600}, dt.datetime(2025, 4, 1)),
        ({"ts": 1743465600123}, dt.datetime(2025, 4, 1, 0, 0, 0, 123000)),
        ({"ts": "2025-04-01T02:00:00+02:00"}, dt.datetime(2025, 4, 1)),
        ({"ts": "20250401"}, dt.datetime(2025, 4, 1)),
        ({"ts": 0, "time": "2025-04-01"}, dt.datetime(2025, 4, 1)),
        ({"ts": "", "@timestamp": "2025-04-01 00:00:00"}, dt.datetime(2025, 4, 1)),
        ({"ts": "Tue, 01 Apr 2025 00:00:00 +0000"}, dt.datetime(2025, 4, 1)),
        ({"ts": "garbage"}, None),
        ({"ts": "1700000000"}, None),
        ({"msg": "no ts"}, None),
    ],
)
def test_timestamps(spark, tmp_path, given, want):
    rows = normalized(spark, [given], tmp_path).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")).collect()
    assert [r["ts"] for r in rows] == ([want.strftime("%Y-%m-%d %H:%M:%S.%f")] if want else [])


def test_records(spark, tmp_path):
    ts = "2025-04-01T00:00:00Z"
    rows = normalized(
        spark,
        [
            "", "  ", "{bad", "[1]", "5", "null",
            {"ts": ts, "event_id": "a", "tech": "aws", "context": 5},
            {"ts": ts, "id": "b", "source": "S", "type": "T", "host": "H", "message": "M", "context": [1], "tags": ["x", "y"]},
            {"ts": ts, "_id": "c", "product": "", "vendor": "V", "context": {}, "attack": [], "attack_techniques": "t1", "msg": True},
            {"ts": ts, "product": "okta", "event_type": "auth.failure", "asset_id": "vpn-1", "msg": "MFA denied"},
            {"ts": ts, "event_id": "a"},
        ],
        tmp_path,
    ).collect()
    got = {r["msg"] + r["event_id"]: r for r in rows}
    assert len(rows) == 5 and sorted(r["event_id"] for r in rows) == sorted(["a", "a", "b", "c", "7262229ad6d47b61"])
    a, b, c = (next(r for r in rows if r["event_id"] == i and (i != "a" or r["tech"])) for i in "abc")
    assert (a["product"], a["msg"], a["tech"], a["context"]) == ("unknown", "", ["aws"], '{"raw":"5"}')
    assert (b["product"], b["event_type"], b["asset_id"], b["msg"], b["context"], b["risk_tag"]) == ("S", "T", "H", "M", "[1]", ["x", "y"])
    assert (c["product"], c["context"], c["attack"], c["msg"]) == ("V", "{}", ["t1"], "True") and got


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ts,product,msg,tech\n1743465600,,"say ""hi"", you",aws\n,okta,x,\n2025-04-01,okta,"two\nlines",\n')
    rows = sorted(ingest.normalize(ingest.read_csv(spark, f"file://{tmp_path}/a.csv")).collect(), key=lambda r: r["product"])
    assert [(r["product"], r["msg"], r["tech"]) for r in rows] == [("okta", "two\nlines", []), ("unknown", 'say "hi", you', ["aws"])]


def test_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,event_id\n2025-04-01,1\n")
    (tmp_path / "b.jsonl").write_text('{"ts":"2025-04-01","id":"1"}\n{"ts":"2025-04-02","id":"2"}\n')
    assert ingest.read_logs(spark, f"file://{tmp_path}").count() == 3
    assert ingest.read_logs(spark, f"file://{tmp_path}", dedup=True).count() == 2
    with pytest.raises(FileNotFoundError):
        ingest.read_logs(spark, f"file://{tmp_path}/none")


def test_sinks(spark, tmp_path):
    rows = [("2025-W01", "2025-W01_c0", 3, ["a", "it's", "c"])]
    df = spark.createDataFrame(rows, "week string, cluster_id string, size long, terms array<string>")
    sinks.write_csv(df, f"file://{tmp_path}/c.csv")
    assert [tuple(r) for r in sinks.read_clusters_csv(spark, f"file://{tmp_path}/c.csv").collect()][0][:3] == rows[0][:3]
    text = spark.read.option("header", True).csv(f"file://{tmp_path}/c.csv").first()["terms"]
    assert text.startswith("['a', ")
    events = spark.createDataFrame([("1", "2025-W01"), ("2", "2025-W02")], "event_id string, week string")
    sinks.write_assignments(events, f"file://{tmp_path}/assignments")
    assert {r["week"] for r in spark.read.parquet(f"file://{tmp_path}/assignments").collect()} == {"2025-W01", "2025-W02"}


def test_generator(spark, tmp_path):
    generator.write_sample_logs(spark, f"file://{tmp_path}/logs.jsonl")
    rows = ingest.normalize(ingest.read_jsonl(spark, f"file://{tmp_path}/logs.jsonl"))
    n = {(r["kind"], r["w"]): r["count"] for r in rows.groupBy(F.substring("event_id", 1, 1).alias("kind"), F.split("event_id", "-")[1].cast("int").alias("w")).count().collect()}
    assert len(n) == 36
    assert all(27 <= n["A", w] <= 33 if 4 <= w <= 8 else 17 <= n["A", w] <= 23 for w in range(12))
    assert all(20 <= n["B", w] <= 30 for w in range(12)) and all(27 <= n["C", w] <= 33 if w < 9 else 7 <= n["C", w] <= 13 for w in range(12))
    assert rows.filter("product = 'snowflake' and split(event_id, '-')[1] < 6").count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"id": str(i), "ts": f"2025-04-{1 + i % 20:02d}T00:00:00Z", "type": "a" if i % 3 else "b"} for i in range(60)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    counts = weekly.weekly_counts(weekly.normalized_stream(spark, f"file://{tmp_path}/in"))
    query = counts.writeStream.format("memory").queryName("weekly").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["week"], r["event_type"]): r["count"] for r in spark.table("weekly").collect()}
    want = {}
    for x in lines:
        y, w, _ = dt.date.fromisoformat(x["ts"][:10]).isocalendar()
        want[(f"{y}-W{w:02d}", x["type"])] = want.get((f"{y}-W{w:02d}", x["type"]), 0) + 1
    assert got == want
