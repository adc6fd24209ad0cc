"""Line dedup: winnowed runs of lines, extended both ways; later repeats go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, stored, table, unpacked_rows

#: Words of the grams whose minima are selected.
GRAM_WORDS = 25
#: Words from which on a repeated run of lines goes.
WINDOW_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["_did", "_th"]


def lines_of(keyed: DataFrame) -> DataFrame:
    """_did, _th, lines: place, two hashes and number of words of each line that has words, one row per text."""
    line = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("p"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("n")))
    rows = keyed.select(*DOC, F.filter(line, lambda x: x["n"] > 0).alias("lines"))
    return rows.filter(F.size("lines") > 0).dropDuplicates(DOC)


def windows(lines: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """_did, _th, f, at, w, x, a, b: the windows of each text and their fingerprints.

    The gram at a line is the least run of lines from it that has `gram` words,
    the window at a line the least run from it or up to it that has `window`
    words; a and b are its first and last line's places, w and x its hash. Of
    the grams within the window from a line on, the one with the least hash f
    is selected, the last of equal ones, and at is its place; a window up to a
    line has the selection of the window from its first line on. So equal
    windows have equal fingerprints at one distance from their beginnings.
    """
    rows = lines.select(*DOC, F.explode("lines").alias("l")).select(*DOC, "l.p", F.struct("l.h", "l.g").alias("h"), "l.n")
    rows = rows.withColumn("e", F.sum("n").over(Window.partitionBy(*DOC).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("s", F.col("e") - F.col("n")).drop("n")
    # a line is needed as long as the words before it, from the first line on, are too few
    ahead = lambda words: Window.partitionBy(*DOC).orderBy("s").rangeBetween(0, words - 1)
    behind = Window.partitionBy(*DOC).orderBy("e").rangeBetween(1 - window, 0)
    rows = rows.withColumns({"gh": F.collect_list("h").over(ahead(gram)), "ge": F.max("e").over(ahead(gram)), "wh": F.collect_list("h").over(ahead(window)), "we": F.max("e").over(ahead(window)), "wb": F.max("p").over(ahead(window))})
    gram_ = F.when(F.col("ge") - F.col("s") >= gram, F.struct(F.xxhash64("gh").alias("f"), (-F.col("p")).alias("i"), "ge"))
    rows = rows.withColumn("gram", gram_).drop("gh", "ge").withColumn("cand", F.collect_list("gram").over(ahead(window)))
    best = F.array_min(F.filter("cand", lambda x: x["ge"] <= F.col("we")))
    rows = rows.select(*DOC, "p", "h", "s", "e", "wh", "we", "wb", F.when(F.col("we") - F.col("s") >= window, best).alias("best"))
    rows = rows.withColumns({"vh": F.collect_list("h").over(behind), "first": F.first(F.struct("p", "s", "we", "best.f", "best.i")).over(behind)})
    made = lambda f, i, h, a, b: F.struct(f.alias("f"), (-i).alias("at"), F.xxhash64(h).alias("w"), F.xxhash64(F.lit(1), h).alias("x"), a.alias("a"), b.alias("b"))
    forward = F.when(F.col("best").isNotNull(), made(F.col("best.f"), F.col("best.i"), F.col("wh"), F.col("p"), F.col("wb")))
    # the window up to a line is another one only if it is longer than that from its first line on
    backward = F.when((F.col("e") - F.col("first.s") >= window) & (F.col("e") > F.col("first.we")), made(F.col("first.f"), F.col("first.i"), F.col("vh"), F.col("first.p"), F.col("p")))
    return rows.select(*DOC, F.explode(F.array_compact(F.array(forward, backward))).alias("w")).select(*DOC, "w.*")


def repeats(docs: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """_did, _th, cuts: the runs [a, b] of each text's lines that repeat earlier ones, in order and apart.

    Positions of a fingerprint that occurs once are dropped. Each position that
    is left is extended both ways, to all the windows that it stands for; a
    window goes if its first occurrence (by document, text hash, line) is
    another one that doesn't overlap it. Occurrences are compared with the
    first one of their own window, not of their fingerprint, so that work is
    linear however common a fingerprint is and no longer run is missed: every
    line of a repeated run of `window` words or more is in a window from a line
    of the run on or up to one.
    """
    found = stored(windows(lines_of(row_key(docs)), gram, window), "line-windows")
    place = F.struct(*DOC, "at")
    twice = found.groupBy("f").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter(F.col("lo") != F.col("hi")).select("f")
    known = stored(found.join(twice, "f", "left_semi").drop("f", "at"), "line-repeats")
    first = known.groupBy("w", "x").agg(F.min(F.struct(*DOC, "a", "b")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    first = stored(first, "line-firsts")  # so that the rows of a very common window can be dealt to several tasks
    own = (F.col("_did") == F.col("first._did")) & (F.col("_th") == F.col("first._th"))
    later = known.join(first, ["w", "x"]).filter(~own | (F.col("a") > F.col("first.b"))).select(*DOC, "a", "b")
    order = Window.partitionBy(*DOC).orderBy("a", "b")
    upto = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("new", F.coalesce((F.col("a") > upto).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = apart.groupBy(*DOC, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts"))


def line_dedup(docs: DataFrame, gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """docs with text without its repeated runs, and n_lines and n_removed.

    Every copy of a run of lines of `window` words or more goes, unless it is
    the first one or overlaps that; shorter runs stay. Blank lines within a
    removed run go with it. The first copy, by doc_id (null last), text hash
    and line, stays, also within one text. Rows that agree in doc_id and text
    count once and are cut alike. A null text stays null. A text may become
    empty; its row stays. Columns named n_lines or n_removed are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = cut(docs, gram, window)
    return rows.select(*((F.col("new") if c == "text" else F.col("_row")[c]).alias(c) for c in columns), "n_lines", "n_removed")


def cut(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """_row, new (the text after dedup), n_lines and n_removed."""
    keyed = row_key(docs).select("_row", *DOC).join(repeats(docs, gram, window).hint("shuffle_hash"), DOC, "left")
    raw = keyed.withColumn("text", F.col("_row")["text"]).withColumn("raw", F.split("text", "\n"))
    # what is before the first run, and from each run to the next
    begins = F.concat(F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"))), "cuts")
    kept = F.flatten(F.transform(begins, lambda c, i: F.slice("raw", c["b"] + 2, F.coalesce(F.get("cuts", i)["a"], F.size("raw")) - c["b"] - 1)))
    rows = raw.withColumn("kept", F.when(F.col("cuts").isNotNull(), kept))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size("raw"), F.lit(0))).cast("long")
    return rows.select(
        "_row",
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("new"),
        n.alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n - F.size("kept")).cast("long").alias("n_removed"),
    )


def deduped(docs: DataFrame) -> DataFrame:
    """docs, all columns, with texts after line_dedup and n_chars of these."""
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("new").cast(docs.schema["n_chars"].dataType)
    return unpacked_rows(cut(docs, GRAM_WORDS, WINDOW_WORDS), docs.columns, **changed)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


#: Windows as texts, all compared with all; doc_id orders texts here, for no two rows of the table share one.
ORACLE = r"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS raw FROM documents),
k AS (SELECT doc_id, raw, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM r),
a AS (SELECT doc_id, raw, l, (sum(n) OVER (PARTITION BY doc_id ORDER BY raw))::BIGINT AS e, (sum(n) OVER (PARTITION BY doc_id ORDER BY raw) - n)::BIGINT AS s FROM k WHERE n > 0),
f AS (SELECT doc_id, raw AS x, max(raw) OVER w AS y, max(e) OVER w - s AS words, list(l) OVER w AS t FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
g AS (SELECT doc_id, min(raw) OVER w AS x, raw AS y, e - min(s) OVER w AS words, list(l) OVER w AS t FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
w AS (SELECT doc_id, x, y, array_to_string(t, chr(10)) AS t FROM f WHERE words >= 50 UNION SELECT doc_id, x, y, array_to_string(t, chr(10)) FROM g WHERE words >= 50),
c AS (SELECT t, min((doc_id, x, y)) AS first FROM w GROUP BY t HAVING count(*) > 1),
d AS (SELECT DISTINCT doc_id, x, y FROM w JOIN c USING (t) WHERE doc_id <> first[1] OR x > first[3]),
v AS (SELECT r.doc_id, r.raw, r.l, EXISTS (SELECT 1 FROM d WHERE d.doc_id = r.doc_id AND r.raw BETWEEN x AND y) AS gone FROM r)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(l, chr(10) ORDER BY raw) FILTER (NOT gone) AS t FROM v GROUP BY doc_id) USING (doc_id)
"""
