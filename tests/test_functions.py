"""Scalar functions against literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import timeweek as W
from tidemark.functions import vectors as V


def one(spark, column, **given):
    row = spark.range(1).select(*(v.alias(k) for k, v in given.items())) if given else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("User login failed from 192.168.1.1", ["user", "login", "failed", "192.168.1.1"]),
        ("Access to /var/log/auth.log on host-01.example.com", ["access", "var/log/auth.log", "host-01.example.com"]),
        ("A big system ok", ["big", "system"]),
        ("Über Maß", ["über", "maß"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("token", "h", "slot"), [("user", 316582255, -47), ("login", 657914546, 50), ("failed", 1600096088, 24), ("test", 2840236005, -37), ("okta", 314965, -21)])
def test_hash32(spark, token, h, slot):
    assert one(spark, T.hash32(F.lit(token))) == h
    assert h % 64 == abs(slot) and (h % 2 == 0) == (slot > 0)


def test_hashing_vectors(spark):
    v = one(spark, T.hashing_vector(T.strings(["user", "login", "failed"]), 64))
    assert {i: round(x, 5) for i, x in enumerate(v) if x} == {24: 0.57735, 47: -0.57735, 50: 0.57735}
    assert one(spark, T.hashing_vector(T.strings([]), 8)) == [0.0] * 8
    assert min(one(spark, T.hashing_vector(T.strings(["user", "login"]), 64, signed=False))) >= 0
    df = spark.createDataFrame([(1, ["user", "login", "failed", "user"]), (2, [])], "id long, t array<string>")
    sparse = {(r["id"], r["slot"]): r["value"] for r in T.hashed_vectors(df, "id", "t", 64).collect()}
    assert sum(x * x for x in sparse.values()) == pytest.approx(1) and {i for i, _ in sparse} == {1}


def test_encoder_agrees_with_expression(spark):
    from tidemark.operators.encode import hash_tokens, query_vector

    dense = one(spark, T.hashing_vector(T.tokens(F.lit("User login failed from 192.168.1.1")), 96))
    assert hash_tokens([["user", "login", "failed", "192.168.1.1"]], 96)[0].tolist() == pytest.approx(dense)
    assert query_vector("User login failed from 192.168.1.1", 96) == pytest.approx(dense)


def test_stable_id(spark):
    got = one(spark, T.stable_id(*(F.lit(x) for x in ("2025-04-01 00:00:00+00:00", "okta", "auth.failure", "vpn-1", "MFA denied"))))
    assert got == "7262229ad6d47b61"


@pytest.mark.parametrize(("age", "want"), [(14, 0.5), (1, 0.951695), (0, 1.0), (-3, 1.0), (None, 0.0)])
def test_recency(spark, age, want):
    now = dt.datetime(2025, 1, 31)
    ts = F.lit(now - dt.timedelta(days=age)) if age is not None else F.lit(None).cast("timestamp")
    assert one(spark, W.recency(ts, F.lit(now), 14)) == pytest.approx(want, abs=1e-6)


def test_fused(spark):
    assert one(spark, W.fused(F.lit(0.9), F.lit(0.2), 1.0)) == pytest.approx(0.9) and one(spark, W.fused(F.lit(0.9), F.lit(0.2), 0.0)) == pytest.approx(0.2)


@pytest.mark.parametrize(("day", "iso", "sunday"), [("2010-01-02", "2009-W53", "2010-W00"), ("2010-01-04", "2010-W01", "2010-W01"), ("2024-12-30", "2025-W01", "2024-W52"), ("2025-04-01", "2025-W14", "2025-W13")])
def test_weeks(spark, day, iso, sunday):
    ts = F.to_timestamp(F.lit(day))
    assert (one(spark, W.iso_week(ts)), one(spark, W.sunday_week(ts))) == (iso, sunday)
    assert one(spark, W.week_sort_key(F.lit(iso))) == int(iso[:4]) * 100 + int(iso[-2:])


def test_weeks_of_all_days(spark):
    days = spark.range(0, 6500).select(F.date_add(F.lit("2009-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for r in days.select("d", W.iso_week("d").alias("i"), W.sunday_week("d").alias("s")).collect():
        y, w, _ = r["d"].isocalendar()
        assert (r["i"], r["s"]) == (f"{y}-W{w:02d}", r["d"].strftime("%Y-W%U"))


def test_week_sort_key_of_junk(spark):
    assert [one(spark, W.week_sort_key(F.lit(x).cast("string"))) for x in ("none", "2024-Wxx", "", None)] == [-1, -1, -1, -1]


def test_text_repr(spark):
    row = spark.createDataFrame([("okta", "auth.failure", "vpn-1", "MFA denied", '{"geo":"DE","method":"push"}', ["okta", "vpn"], [], [])], "product string, event_type string, asset_id string, msg string, context string, tech array<string>, attack array<string>, risk_tag array<string>")
    assert row.select(T.text_repr()).first()[0] == "[source=okta] [type=auth.failure] [entity=vpn-1] msg=MFA denied geo=DE method=push tech=okta,vpn"
    assert row.select(T.text_repr(include_tags=False)).first()[0].endswith("method=push")


@pytest.mark.parametrize(
    ("context", "want"),
    [('{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6,"g":7}', ["a=1", "b=2", "c=3", "d=4", "e=5", "f=6"]), ('{"a":1,"b":null,"a":2}', ["a=2", "b=None"]), ("[1,2]", []), ("not json", []), (None, []), ("{}", [])],
)
def test_context_pairs(spark, context, want):
    assert one(spark, T.context_pairs(F.lit(context).cast("string"))) == want


@pytest.mark.parametrize(("terms", "want"), [("['msg', 'okta', 'vpn', 'type', 'mfa', 'auth']", "okta vpn mfa"), ("['msg', 'type']", "cluster"), ("", "cluster"), ("source pc", "pc")])
def test_short_label(spark, terms, want):
    assert one(spark, T.short_label(F.lit(terms))) == want


@pytest.mark.parametrize(("a", "b", "want"), [(["a", "b"], ["b", "c"], 2 / 3), (["a"], ["a"], 0.0), (["a"], [], 1.0), ([], [], None)])
def test_term_distance(spark, a, b, want):
    got = one(spark, T.term_distance(T.strings(a), T.strings(b)))
    assert got == (pytest.approx(want) if want is not None else None)


def test_keywords(spark):
    assert one(spark, T.contains_any(F.lit("Okta VPN"), ["vpn", "x"])) and not one(spark, T.contains_any(F.lit(None).cast("string"), ["vpn"]))
    assert one(spark, T.keyword_hits(F.lit("okta vpn"), ["okta", "vpn", "mfa"])) == 2 and one(spark, T.contains_keyword(F.lit("QUALYS scan"), "qualys"))


def test_top_terms(spark):
    df = spark.createDataFrame([(1, "beta alpha beta the the the"), (1, "gamma alpha a"), (2, "the of")], "g int, t string")
    assert {r["g"]: r["terms"] for r in T.top_terms(df, ["g"], "t", 2).collect()} == {1: ["beta", "alpha"]}


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.dot(a, b)) == 24 and one(spark, V.norm(a)) == 5 and one(spark, V.cosine(a, b)) == pytest.approx(0.96) and one(spark, V.square_distance(a, b)) == 2
    assert one(spark, V.cosine(a, zero)) == 0 and one(spark, V.unit(a)) == pytest.approx([0.6, 0.8]) and one(spark, V.unit(zero)) == [0.0, 0.0]


def test_silhouette_and_wss(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    label = np.array([0] * 20 + [1] * 19 + [2])
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(label, x, strict=True)], "label int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i, c in enumerate(label):
        same = (label == c) & (np.arange(40) != i)
        a = d[i, same].mean() if same.any() else None
        b = min(d[i, label == o].mean() for o in range(3) if o != c)
        s.append(0 if a is None else (b - a) / max(a, b))
    assert V.silhouette(df, [], "label", "v", 6).first()[0] == pytest.approx(np.mean(s))
    want = sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in range(3))
    assert V.wss(df.withColumn("k", F.lit(1)), ["k"], "label", "v", 6).first()["wss"] == pytest.approx(want)
