"""Matching, trends, clustering, retrieval, evaluation, validation and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import encode, evaluate, kmeans, matching, retrieval, trends, validate
from tidemark.plans.config import Config


def test_greedy_conflicts(spark):
    pairs = [(0, 0, 0.95), (0, 1, 0.90), (1, 0, 0.93), (1, 1, 0.60), (2, 2, 0.50), (3, 1, 0.55)]
    df = spark.createDataFrame([("w2", c, "w1", p, s) for c, p, s in pairs], "week string, label int, prev_week string, prev_label int, sim double")
    assert {(r["label"], r["prev_label"], r["sim"]) for r in matching.greedy(df).collect()} == {(0, 0, 0.95), (1, 1, 0.60), (2, 2, 0.50)}


def test_greedy_properties(spark):
    rng = np.random.default_rng(2)
    rows = [(w, c, v, 10) for w in ("2024-W01", "2024-W02", "2024-W05") for c, v in enumerate(rng.normal(size=(7, 4)).tolist())]
    clusters = spark.createDataFrame(rows, "week string, label int, centroid array<double>, size int")
    pairs = {(r["week"], r["label"], r["prev_label"]): r["sim"] for r in matching.pairs(clusters, 0.3).collect()}
    got = matching.greedy(matching.pairs(clusters, 0.3)).collect()
    assert {r["prev_week"] for r in got} <= {"2024-W01", "2024-W02"} and all(r["prev_week"] == "2024-W02" for r in got if r["week"] == "2024-W05")
    cur, old = {(r["week"], r["label"]) for r in got}, {(r["week"], r["prev_label"]) for r in got}
    assert len(cur) == len(old) == len(got) and all(r["sim"] >= 0.3 for r in got)
    assert all((w, c) in cur or (w, p) in old for w, c, p in pairs)


@pytest.mark.parametrize(
    ("prev", "size", "sim", "shared", "want"),
    [(None, 10, None, 0, "emergence"), (100, 100, 0.95, 6, "stable"), (100, 100, 0.75, 6, "drift"), (100, 100, 0.95, 3, "drift"), (100, 100, 0.95, 4, "stable"), (100, 49, 0.95, 6, "decay"), (100, 50, 0.95, 6, "stable"),
     (100, 49, 0.75, 6, "decay"), (100, 151, 0.75, 6, "growth"), (100, 150, 0.95, 6, "stable"), (18, 29, 0.95, 6, "stable"), (19, 30, 0.95, 6, "growth")],
)
def test_ladder(spark, prev, size, sim, shared, want):
    terms = list("abcdef")
    old = terms[:shared] + [f"z{i}" for i in range(6 - shared)]
    df = spark.createDataFrame([(size, prev, sim, terms, old if prev else None)], "size int, prev_size int, sim double, terms array<string>, prev_terms array<string>")
    row = trends.classify(df).first()
    assert (row["type"], row["delta_size"], round(row["drift"], 3)) == (want, size - (prev or 0), round(1 - sim, 3) if sim else 0.0)


def test_elbow(spark):
    rows = [("a", k, w) for k, w in zip(range(2, 7), [100.0, 60.0, 50.0, 48.0, 47.0], strict=True)] + [("b", 2, 9.0), ("b", 3, 1.0)]
    assert {r["week"]: r["k"] for r in kmeans.elbow_picks(spark.createDataFrame(rows, "week string, k int, wss double")).collect()} == {"a": 3, "b": 2}


def blobs(spark, k=3, n=40):
    rng = np.random.default_rng(4)
    rows = [(w, c, (5 * np.eye(4)[c] + rng.normal(scale=0.3, size=4)).tolist()) for w in ("2024-W01", "2024-W02") for c in range(k) for _ in range(n)]
    return spark.createDataFrame([*rows, ("2024-W03", 0, [0.0] * 4)], "week string, true int, vector array<double>").repartition(3)


def test_kmeans_finds_blobs(spark):
    df = kmeans.cluster_weeks(blobs(spark), 3, inits=3)
    sizes = df.groupBy("week", "true", "label").count().collect()
    assert len(sizes) == 6 and all(r["count"] == 40 for r in sizes)


def test_kmeans_inertia_is_that_of_the_centres(spark):
    df = blobs(spark)
    (e, centres) = kmeans.fit(df, {"2024-W01": [2]}, inits=2)["2024-W01", 2]
    x = np.array([r["vector"] for r in df.filter("week = '2024-W01'").collect()])
    assert e == pytest.approx(kmeans.nearest(x, centres)[1].sum(), rel=1e-3)


def test_first_centres_are_drawn_from_all_vectors(spark):
    """However often vectors repeat, each group of them gets a centre."""
    rng = np.random.default_rng(6)
    x = [(8 * np.eye(4)[c] + rng.normal(scale=0.1, size=4)).tolist() for c in range(4) for _ in range(3)]
    df = spark.createDataFrame([("w", v) for v in x], "week string, vector array<double>")
    often = df.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(2500)))).drop("_")
    (cost, centres) = kmeans.fit(often, {"w": [4]}, inits=3)["w", 4]
    assert len(np.unique(centres.round(6), axis=0)) == 4
    means = np.array(x).reshape(4, 3, 4).mean(axis=1)
    assert cost == pytest.approx(2500 * ((np.array(x).reshape(4, 3, 4) - means[:, None]) ** 2).sum(), rel=1e-6)
    same = spark.createDataFrame([("w", [1.0, 2.0])] * 30 + [("w", [1.0, 3.0])], "week string, vector array<double>")
    assert kmeans.fit(same, {"w": [2]}, inits=1)["w", 2][0] == 0 and len(kmeans.fit(same, {"w": [3]}, inits=1)["w", 3][1]) == 3


def test_fits_in_one_task_are_those_of_many(spark):
    df = blobs(spark)
    ks = {"2024-W01": [1, 2, 3, 5], "2024-W02": [4], "2024-W03": [2]}
    one, many = (kmeans.fit(df, ks, inits=4, task_bytes=b) for b in (1 << 30, 0))
    assert one.keys() == many.keys() and len(one) == 6
    for c, (cost, centres) in one.items():
        assert cost == pytest.approx(many[c][0], rel=1e-9, abs=1e-12) and np.allclose(centres, many[c][1])


def test_k_choices(spark):
    df = blobs(spark)
    assert kmeans.pick_by_silhouette(df, 2, 5, inits=2) == {"2024-W01": 3, "2024-W02": 3}
    assert {r["week"]: r["k"] for r in kmeans.elbow_picks(kmeans.elbow_table(df, 2, 5, inits=2)).collect()} == {"2024-W01": 3, "2024-W02": 3}


def test_silhouettes_come_with_the_fits(spark, monkeypatch):
    """Of counted rows as of the rows that these stand for, in one task as in many, and as from a pass over all rows."""
    df = blobs(spark).withColumn("n", F.lit(3))
    each = df.withColumn("_", F.explode(F.sequence(F.lit(1), "n"))).select("week", "vector")
    ks = {"2024-W01": [1, 2, 3, 5], "2024-W02": [4]}
    one, many = (kmeans.fitted(kmeans.counted(df), ks, 42, 3, task_bytes=b, scored=True) for b in (1 << 30, 0))
    for (w, k), (_, centres, score) in one.items():
        want = V.silhouette(kmeans.assign(each, {w: centres}), ["week"], "label", "vector", 4).first()
        assert many[(w, k)][2] == (None if k == 1 else pytest.approx(score, abs=1e-9)) and score == (want and pytest.approx(want["silhouette"], abs=1e-9))
    monkeypatch.setattr(V, "silhouette", None)  # no pass over all rows for each k
    for rows in (df, each):
        for task_bytes in (1 << 30, 0):
            assert kmeans.pick_by_silhouette(rows, 2, 5, inits=2, task_bytes=task_bytes) == {"2024-W01": 3, "2024-W02": 3}


def test_asof_never_returns_later_rows(spark):
    events = spark.createDataFrame([(i, f"2024-01-{1 + i % 28:02d} 00:00:00", [float(i % 3), 1.0]) for i in range(80)], "event_id long, ts string, vector array<double>").withColumn("ts", F.col("ts").cast("timestamp"))
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query string, qvec array<double>")
    found = retrieval.asof_topk(events, queries, 202402, 50)
    assert found.count() > 10 and not retrieval.asof_violations(found, 202402).first()[0]
    recent = retrieval.fused_topk(events, queries, 1, alpha=0.0).first()
    assert str(recent["ts"])[:10] == "2024-01-28"


def test_report(spark):
    pairs = spark.createDataFrame([("growth", "growth"), ("growth", "stable"), ("drift", "growth"), ("drift", "drift")], "gold string, pred string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in evaluate.report(pairs).collect()}
    assert got == {"growth": (0.5, 0.5, 0.5, 2), "drift": (1.0, 0.5, pytest.approx(2 / 3), 2), "decay": (0.0, 0.0, 0.0, 0)}
    assert evaluate.macro_f1(pairs).first()[0] == pytest.approx((0.5 + 2 / 3) / 3)


def test_validators(spark):
    bad = spark.createDataFrame([("a", None), ("a", "2024-01-01"), (None, "2024-01-01")], "event_id string, ts string").withColumns({c: F.lit("x") for c in ("product", "event_type", "asset_id", "msg")})
    assert validate.normalized_errors(bad) == ["1 null event ids", "1 null timestamps", "1 duplicate event ids"]
    assert validate.normalized_errors(bad.drop("msg")) == ["Missing required columns: ['msg']"]
    v = spark.createDataFrame([([1.0, float("nan")],), ([float("inf")],), (None,)], "vector array<double>")
    assert validate.embedding_errors(v, 2) == ["1 null vectors", "1 vectors of another dimension", "1 NaN elements", "1 infinite elements"]
    assert validate.raw_errors(spark.createDataFrame([(1, None), (None, None), (None, "m")], "ts int, msg string")) == ["Field 'ts' missing in 66.7% of events", "Field 'msg' missing in 66.7% of events"]
    t = spark.createDataFrame([("w", "odd", "c", 1, 0.0)], "week string, type string, cluster_id string, delta_size int, drift double")
    c = spark.createDataFrame([("w", "c", 1, ["a"])], "week string, cluster_id string, size int, terms array<string>")
    assert validate.result_errors(c, t, 2) == ["1 clusters under 2 events", "Invalid trend types found: ['odd']"]


def test_raw_records(spark):
    lines = spark.createDataFrame([('{"ts": 1}',), ("[1]",), ('{"msg": "x", "ts": null}',), (None,)], "value string").select(F.try_parse_json("value").alias("record"))
    assert validate.record_errors(lines) == ["2 records are no objects", "Field 'ts' missing in 75.0% of events", "Field 'msg' missing in 75.0% of events"]
    assert validate.record_errors(lines.limit(0)) == ["No events found"]


def test_other_encoders(spark):
    """A model that is made once in each task; vectors have length one, zeros stay."""
    df = spark.createDataFrame([("a", "t", "h", "aab", "{}")], "product string, event_type string, asset_id string, msg string, context string").withColumns({c: F.array().cast("array<string>") for c in ("tech", "attack", "risk_tag")})
    row = encode.embed_with(df, lambda: lambda texts: np.array([[t.count("a"), t.count("z"), 0.0] for t in texts])).first()
    assert row["text_repr"] == "[source=a] [type=t] [entity=h] msg=aab" and row["vector"] == [1.0, 0.0, 0.0]
    zero = encode.embed_with(df, lambda: lambda texts: np.zeros((len(texts), 2)), "float16").first()
    assert zero["vector"] == [0.0, 0.0]


def test_stages_name_what_is_missing(spark, tmp_path):
    from tidemark.plans import log, pipeline

    cfg = Config.from_dict({"paths": {"root": f"file://{tmp_path}"}})
    for stage, error, first in (("embed", log.EmbeddingError, "ingest"), ("cluster", log.ClusteringError, "embed"), ("evaluate", log.PipelineError, "embed"), ("dashboard", log.PipelineError, "cluster")):
        with pytest.raises(error, match=f"run the stage {first} first"):
            pipeline.STAGES[stage](spark, cfg, True)


def test_config(tmp_path):
    cfg = Config.from_dict({"clustering": {"default_k": 4}, "paths": {"root": "/x"}})
    cfg.to_yaml(str(tmp_path / "c.yaml"))
    again = Config.from_yaml(str(tmp_path / "c.yaml"))
    assert again == cfg and again.paths.events == "/x/data/events.parquet" and Config.from_yaml(str(tmp_path / "none.yaml")) == Config()
    with pytest.raises(ValueError, match="unknown settings"):
        Config.from_dict({"other": {}})


def test_whole_run(spark, tmp_path):
    from tidemark.plans import pipeline
    from tidemark.sources import generator

    root = f"file://{tmp_path}"
    generator.write_sample_logs(spark, f"{root}/logs/sample.jsonl")
    cfg = Config.from_dict({"paths": {"root": root}, "model": {"dimension": 64}, "clustering": {"default_k": 3}})
    for stage in pipeline.STAGES.values():
        stage(spark, cfg, True)
    views = pipeline.dashboard(spark, cfg)
    weeks = {r["week"] for r in spark.read.parquet(f"{root}/results/clusters.parquet").select("week").distinct().collect()}
    assert len(weeks) in (12, 13) and views["clusters"].count() >= 2 and views["trends"].count() >= 30
    found = {r["type"] for r in views["trends"].collect()}
    assert "emergence" in found and "stable" in found and found <= set(trends.TYPES)
    f1 = spark.read.option("header", True).csv(f"{root}/results/trend_macro_f1.csv").first()
    assert 0.0 <= float(f1["macro_f1"]) <= 1.0
