"""Quality rules: text statistics and robust multivariate outliers (MCD)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, row_key, stored, table, unpacked_rows, words

#: The share of a group's documents whose covariance has the least determinant.
SHARE = 0.75
#: Concentration steps go on as long as they lower the logarithm of the determinant by more than this.
SETTLED = 1e-3
#: Documents of its parent's fit that count in a group's fit besides its own.
PRIOR = 200
#: Squared distances are told apart in steps of a 16th of an octave.
GRID = 16
#: Medians, from which the steps start, are found on a grid of this many cells a unit.
UNIT = 64
#: Standard deviations under which a statistic's spread doesn't count (ridge of the covariance).
RIDGE = (0.08, 0.4, 0.6, 0.6, 1.0)
#: Standard deviations that all documents are taken to have before any is seen; they count PRIOR times.
SPREAD = (0.25, 1.5, 1.5, 1.5, 1.5)
#: Chance that a clean document's distance is over the cut, were the statistics normal.
TAIL = 1e-12
DIM = len(RIDGE)
X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
#: Columns: of a group, and of its fit.
G, M = ["lv", "l", "k"], [f"m{i}" for i in range(DIM)]
S, W = [f"s{i}{j}" for i, j in PAIRS], [f"w{i}{j}" for i, j in PAIRS]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution, by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while abs(term) > 1e-17 * abs(total):
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_cut(tail: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - chi2_cdf(mid, k) > tail else (lo, mid)
    return hi


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Everything is counted within the row. A null text has no words. Windows of
    three words are told apart by 64-bit hashes; only texts in which a hash
    repeats sort theirs, to find the words that repeated windows cover.
    """
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_t")).withColumn("_w", words("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_replace(x, GAP, "") != "")
    n = F.size("_w")
    windows = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_h"),
    )
    sorted_ = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.select("*", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), sorted_.alias("_s"))
    twice = F.filter("_s", lambda e, i: (e["h"] == F.get("_s", i - 1)["h"]) | (e["h"] == F.get("_s", i + 1)["h"]))
    at = F.sort_array(F.transform(twice, lambda e: e["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")))["n"]
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("_s").isNull(), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The statistics on scales on which clean documents spread evenly."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(1000 * F.col("n_symbols") / n),
        F.log1p(1000 * F.col("n_dup_lines") / n),
        F.log1p(100 * F.col("n_repeat_words") / n),
        F.log(n),
    ]


def medians(rows: DataFrame, values: list[Column], unit: int = UNIT) -> DataFrame:
    """Per group the medians m0.. of values on a grid of 1/unit, from counts."""
    cells = rows.select(*G, F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.round(v * unit).cast("long").alias("q")) for i, v in enumerate(values)))).alias("c"))
    counts = stored(cells.groupBy(*G, "c.f", "c.q").count(), "quality-cells")
    upto = Window.partitionBy(*G, "f")
    half = counts.withColumns({"before": F.sum("count").over(upto.orderBy("q")), "all": F.sum("count").over(upto)}).filter(2 * F.col("before") >= F.col("all"))
    return half.groupBy(*G).agg(*(F.min(F.when(F.col("f") == i, F.col("q") / unit)).alias(f"m{i}") for i in range(len(values))), F.max("all").alias("n"))


def factor(moments: DataFrame) -> DataFrame:
    """moments and w00.., the inverse of the Cholesky factor of s00.. plus the ridge, and the logdet of these.

    It is written out, so that the chain of steps isn't part of later plans.
    """
    given = moments.columns
    for j in range(DIM):  # a column of the factor at a time, the diagonal first
        rest = {i: " - ".join([f"s{i}{j}" + (f" + {RIDGE[i] ** 2}D" if i == j else ""), *(f"l{i}{k} * l{j}{k}" for k in range(j))]) for i in range(j, DIM)}
        moments = moments.selectExpr("*", f"sqrt(greatest({rest[j]}, 1e-12D)) AS l{j}{j}")
        moments = moments.selectExpr("*", *(f"({rest[i]}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, DIM)))
    for off in range(DIM):  # its inverse by diagonals
        inner = {j: " + ".join(f"l{j + off}{k} * w{k}{j}" for k in range(j, j + off)) for j in range(DIM - off)}
        moments = moments.selectExpr("*", *(f"{f'-({x})' if off else '1D'} / l{j + off}{j + off} AS w{j + off}{j}" for j, x in inner.items()))
    logdet = " + ".join(f"ln(l{i}{i})" for i in range(DIM))
    return stored(moments.selectExpr(*given, *W, f"2 * ({logdet}) AS logdet"), "quality-fit")


def grouped(rows: DataFrame, *lvs: int) -> DataFrame:
    """Each row in its groups: lv, l, k are 1, language, source; 2, language; 3. Nulls are a value of their own."""
    lang, source, none = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00")), F.lit("")
    keys = {1: (lang, source), 2: (lang, none), 3: (none, none)}
    parts = [rows.select(F.lit(lv).alias("lv"), keys[lv][0].alias("l"), keys[lv][1].alias("k"), *(c for c in rows.columns if c not in ("lang", "source"))) for lv in lvs]
    return reduce(DataFrame.unionByName, parts)


def distances(rows: DataFrame, fitted: DataFrame, *lvs: int) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, for each fit of their groups; the fits' s and logdet stay.

    Every level is joined by itself: only sources can be so many that their fits aren't sent to all tasks.
    """
    parts = [" + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) for i in range(DIM)]
    d2 = " + ".join(f"({p}) * ({p})" for p in parts)
    fits = fitted.select(*G, "s", "logdet", *M, *W)
    of = {lv: fits.filter(f"lv = {lv}") for lv in lvs} | {3: F.broadcast(fits.filter("lv = 3"))}  # one group
    joined = [grouped(rows, lv).join(of[lv], G) for lv in lvs]
    return reduce(DataFrame.unionByName, joined).withColumn("d2", F.expr(d2)).drop(*M, *W)


def moments(sums: DataFrame, scale: float) -> DataFrame:
    """Means and scaled covariances from n, a0.. and b00.. per group and start."""
    return sums.selectExpr(*G, "s", "n", "old", *(f"a{i} / n AS m{i}" for i in range(DIM)), *(f"(b{i}{j} / n - a{i} / n * (a{j} / n)) * {scale}D AS s{i}{j}" for i, j in PAIRS))


def gathered() -> list[Column]:
    """Per group and start: what the fit before had as logdet, and the sums of rows."""
    made = ["max(logdet) AS old", "count(1) AS n", *(f"sum(x{i}) AS a{i}" for i in range(DIM)), *(f"sum(x{i} * x{j}) AS b{i}{j}" for i, j in PAIRS)]
    return [F.expr(x) for x in made]


def added() -> list[Column]:
    return [F.max("old").alias("old"), *(F.expr(f"sum({c}) AS {c}") for c in ("n", *(f"a{i}" for i in range(DIM)), *(f"b{i}{j}" for i, j in PAIRS)))]


def starts(rows: DataFrame) -> DataFrame:
    """Three first fits of each group: medians with scaled median deviations, medians with the ridge, means and covariance of all.

    They are no fits of a share of the documents, so their determinants count as infinite.
    """
    rows = grouped(rows, 1, 2, 3)
    mid = stored(medians(rows, [F.col(x) for x in X]), "quality-medians")
    apart = medians(rows.join(mid.drop("n"), G), [F.abs(F.col(x) - F.col(m)) for x, m in zip(X, M, strict=True)])
    apart = apart.select(*G, *(F.col(m).alias(f"q{i}") for i, m in enumerate(M)))
    diagonal = lambda v: [(v(i) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS]
    first = mid.join(apart, G).select(*G, F.lit(0).alias("s"), "n", *M, *diagonal(lambda i: F.pow(1.4826 * F.col(f"q{i}"), 2)))
    second = mid.select(*G, F.lit(1).alias("s"), "n", *M, *diagonal(lambda i: F.lit(0.0)))
    whole = rows.withColumns({"s": F.lit(2), "logdet": F.lit(0.0)}).groupBy(*G, "s").agg(*gathered())
    return factor(first.unionByName(second).unionByName(moments(whole, 1.0).drop("old"))).withColumn("logdet", F.lit(math.inf))


def mcd(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """Minimum-covariance-determinant location and scatter of each group, of three starts.

    Each concentration step takes the documents with the least distances, until
    they are `share` of the group, and fits the means and covariance of these; a
    fit is settled when a step doesn't lower its determinant. Distances are
    compared on a grid, so that a step needs sums by group and grid cell only,
    which are combined before the shuffle and a few hundred a group after. The
    start with the least determinant wins. Scatter is made consistent with the
    normal distribution.
    """
    active = starts(rows)
    settled = [active.select(*G, "s", "n", "logdet", *M, *S).limit(0)]  # a table without rows settles nothing
    consistent = share / chi2_cdf(chi2_cut(1 - share, DIM), DIM + 2)
    order = Window.partitionBy(*G, "s")
    while not active.isEmpty():
        cell = F.floor(F.log2(F.col("d2") + 1e-6) * GRID)
        sums = stored(distances(rows, active, 1, 2, 3).groupBy(*G, "s", cell.alias("cell")).agg(*gathered()), "quality-sums")
        upto = F.sum("n").over(order.orderBy("cell")) - F.col("n")
        inner = sums.withColumns({"before": upto, "all": F.sum("n").over(order)}).filter(F.col("before") < share * F.col("all"))
        new = factor(moments(inner.groupBy(*G, "s").agg(*added()), consistent))
        less = F.col("old") - F.col("logdet") > SETTLED
        settled.append(active.join(new.filter(~less).select(*G, "s"), [*G, "s"], "left_semi").select(*G, "s", "n", "logdet", *M, *S))
        active = new.filter(less)
    fits = stored(reduce(DataFrame.unionByName, settled), "quality-settled")
    best = fits.groupBy(*G).agg(F.min(F.struct("logdet", "s")).alias("b")).select(*G, "b.s")
    return fits.join(best, [*G, "s"]).select(*G, "n", *M, *S)


def shrunk(fits: DataFrame) -> DataFrame:
    """The fits of groups as if PRIOR documents drawn from their parents' were in them.

    The parent of a source is its language, that of a language all documents;
    to these, documents with the same means and the spread SPREAD are added.
    """
    fits = stored(fits, "quality-moments")
    w = f"(n / (n + {PRIOR}D))"

    def drawn(children: DataFrame, parents: DataFrame) -> DataFrame:
        mean = [f"p{m} + {w} * ({m} - p{m}) AS {m}" for m in M]
        cov = [f"{w} * s{i}{j} + (1 - {w}) * ps{i}{j} + {w} * (1 - {w}) * (m{i} - pm{i}) * (m{j} - pm{j}) AS s{i}{j}" for i, j in PAIRS]
        both = children.join(parents, "l") if "l" in parents.columns else children.crossJoin(F.broadcast(parents))  # one row
        return both.selectExpr(*G, *mean, *cov)

    as_parent = lambda df, *keys: df.selectExpr(*keys, *(f"{c} AS p{c}" for c in (*M, *S)))
    every = fits.filter("lv = 3").selectExpr(*G, *M, *(f"{w} * s{i}{j}" + (f" + (1 - {w}) * {SPREAD[i] ** 2}D" if i == j else "") + f" AS s{i}{j}" for i, j in PAIRS))
    tongues = drawn(fits.filter("lv = 2"), as_parent(every))
    sources = drawn(fits.filter("lv = 1"), as_parent(tongues, "l"))
    return factor(every.unionByName(tongues).unionByName(sources).withColumn("s", F.lit(0)))


def verdicts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source"), tail: float = TAIL) -> DataFrame:
    """keep, the statistics, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated windows
    of three. The others are vectors (word length, symbols, repeated lines,
    repeated words, length; on log scales), grouped by language and source; a
    vector is rejected if its robust distance is over the `tail` point of the
    chi-squared distribution. Every group has a fit of its own (mcd), drawn
    towards that of its language, and this towards that of all documents, the
    more the fewer documents it has (shrunk); after that, documents within the
    97.5 % point are fitted and drawn once more. There is no least size: a
    source with one document is judged almost by its language, a table with
    one almost by SPREAD. A null language or source is a value of its own.
    Repeated rows are judged alike. `keep` names the columns that identify a
    row; lang and source must be among them.
    """
    counted = stored(statistics(docs, text, keep), "quality-counts")
    ok = counted.filter(~base_failed()).select("*", *(v.alias(x) for v, x in zip(vector(), X, strict=True)))
    ok = stored(ok, "quality-vectors")
    rows = ok.select("lang", "source", *X)
    inside = chi2_cut(0.025, DIM)
    first = shrunk(mcd(rows))
    near = distances(rows, first, 1, 2, 3).filter(F.col("d2") <= inside).groupBy(*G, "s").agg(*gathered())
    again = moments(near, 0.975 / chi2_cdf(inside, DIM + 2)).selectExpr(*G, "n", *(f"{c} AS r{c}" for c in (*M, *S)))
    # a group without a document within the point is its parent's
    again = first.join(again, G, "left").selectExpr(*G, "coalesce(n, 0) AS n", *(f"coalesce(r{c}, {c}) AS {c}" for c in (*M, *S)))
    columns = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = distances(ok.select(F.struct(*columns).alias("_c"), "lang", "source", *X), shrunk(again), 1)
    judged = own.select("_c.*", F.lit(False).alias("base_failed"), (F.col("d2") <= chi2_cut(tail, DIM)).alias("kept"))
    failed = counted.filter(base_failed()).select(*columns, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    keyed = row_key(docs)
    good = verdicts(keyed, keep=("_did", "_th", "lang", "source")).filter("kept").select(F.col("_did").alias("d"), F.col("_th").alias("t"), F.col("lang").alias("l"), F.col("source").alias("k"))
    same = (keyed["_did"] == good["d"]) & (keyed["_th"] == good["t"]) & keyed["lang"].eqNullSafe(good["l"]) & keyed["source"].eqNullSafe(good["k"])
    return unpacked_rows(keyed.join(good, same, "left_semi"), docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).drop("lang", "source")
