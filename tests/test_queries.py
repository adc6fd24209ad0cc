"""Every registered query of the engine against its DuckDB form."""

import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLES[name]})')
    assert sorted(duck.sql(catalog.ORACLES[name]).columns) == columns
    got = sorted(str([plain(x) for x in r]) for r in df.select(*columns).collect())
    assert got == sorted(str([plain(x) for x in r]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_picks_reach_over_six_clusters(spark, tmp_path):
    rows = [(8 * c + i, [10.0 * (j == c) + 0.1 * (j == 8 + i) for j in range(64)], c) for c in range(8) for i in range(3)]
    rows = [(n, x, c) for n, (_, x, c) in enumerate(rows)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    events = spark.range(24).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-02 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("silhouette_pick_k", "elbow_pick_k"):
        assert [(r["week"], r["k"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] == [("2024-W01", 8)]


def test_centroids_keep_the_sign_of_zero_and_take_rows_without_vector_or_label(spark, tmp_path):
    rows = [(0, [-3e-7] + [0.5] * 63, 0), (1, [1e-7] + [-0.25] * 63, 0), (2, None, 0), (3, [1.0] * 64, None), (4, [2.0] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    events = spark.range(10).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-02 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.QUERIES["cluster_centroids"](spark, str(tmp_path)).select("week", "label", "size", "centroid").collect()
    want = con.sql(f"SELECT week, label, size, centroid FROM ({catalog.ORACLES['cluster_centroids']})").fetchall()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want)) and "-0.0" in str(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
