"""The pipeline's stages, each against what it must keep and change."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.common import fresh, table


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        place = fresh(spark, "test-stage")
        stage(spark, docs, sf).write.parquet(place)
        seen[name] = (docs, spark.read.parquet(place))
        docs = seen[name][1]
    for name in ("quality rules", "line dedup", "near dedup", "mixing"):
        assert seen[name][1].columns == columns
    before, after = seen["quality rules"]
    want = {r["doc_id"] for r in quality.verdicts(before).filter("kept").collect()}
    assert {r["doc_id"] for r in after.collect()} == want
    before, after = seen["line dedup"]
    assert after.count() == before.count() and after.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    before, after = seen["near dedup"]
    assert after.groupBy("text").count().filter("count > 1").count() == 0
    assert after.join(before, columns, "left_anti").count() == 0
    before, after = seen["mixing"]
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    before, after = seen["bpe"]
    assert after.count() == before.count() and after.filter(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "ids_sha256").collect())
    assert rows(got) == rows(again)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, equal rows, empty and long texts, names that operators use; and no rows at all."""
    line = " ".join(f"word{i}" for i in range(70))
    rows = [
        (1, f"{line}\n{line} more", "en", "a", 1, 0), (2, f"head of it\n{line}\nand {line}", "en", "a", 2, 0), (2, f"head of it\n{line}\nand {line}", "en", "a", 2, 0),
        (None, f"none {line}", None, None, None, 1), (3, None, "en", "a", None, 1), (4, "", "en", None, 0, 1), (5, "one", None, "b", 3, 1), (6, "\n".join(f"{i} {line}" for i in range(3000)), "de", "b", 9, 1),
        (7, f"Ünï \U0001f600 <|endoftext|> \x00 {line} x", "fr", "c", 9, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _did long").withColumns({c: F.lit(1) for c in ("copies", "kept", "h", "id", "u", "key", "times", "first")})
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "")
            if name != "bpe":
                assert got.columns == docs.columns
            n = got.count()
            assert n == 0 if docs is not df else n > 0
            if name == "near dedup" and docs is df:
                assert got.groupBy("doc_id", "text").count().filter("count > 1").isEmpty()
