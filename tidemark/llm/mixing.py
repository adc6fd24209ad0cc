"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, row_key, stored, table, unpacked_rows

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix in parts of all words, and the most copies of a document.
SHARE, COPIES = 1.5, 2
#: Rows that one task makes at most of a repeated row.
BLOCK = 4096
#: Newton stops once every source is as near as this, in parts of its target.
NEAR, STEPS = 1e-10, 60
#: Digits of the rounding cut: ROUNDS times log2(DIGIT) bits.
DIGIT, ROUNDS = 1024, 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = COPIES) -> DataFrame:
    """k, source_size, n_docs, target: each source's words in the mix; sizes: k, source, size, times.

    Weights go to the sources in code point order, null last. A target over
    `most` times its source's size stops there, and the others share the rest
    by weight: the level at which that comes out is found in one pass over the
    sources by the ratio at which each of them stops.
    """
    src = sizes.groupBy("k", "source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n_docs"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")).cast("double"))
    src = src.withColumns({"cap": (F.col("source_size") * most).cast("double"), "ratio": F.col("source_size") * most / F.col("weight")})
    order, all_ = Window.orderBy("ratio", "k"), Window.partitionBy(F.lit(1))
    src = src.withColumns({"total": F.sum("source_size").over(all_) * share, "w_all": F.sum("weight").over(all_)})
    level = F.try_divide(F.col("total") - (F.sum("cap").over(order) - F.col("cap")), F.col("w_all") - (F.sum("weight").over(order) - F.col("weight")))
    src = src.withColumn("level", level)
    src = src.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(all_)["level"])
    return src.select("k", "source", "source_size", "n_docs", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def rate(most: int = COPIES):
    """min(most, exp(lam * size / mean)): the tilted rate of a document."""
    return F.when(F.col("lam").isNull(), F.col("flat")).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))


def tilted(sizes: DataFrame, goals: DataFrame, most: int = COPIES) -> DataFrame:
    """k, mean, lam, flat: the multiplier of each source's token constraint.

    The rates nearest to one copy each in relative entropy, between 0 and
    `most`, whose words add up to the target, are min(most, exp(lam * size)).
    lam is the zero of the dual's gradient. Rows are summed up to their distinct
    sizes first, as many as there are lengths of texts; then each source's
    iterations run on these numbers, sources side by side. The step is Newton's
    on the logarithm of the sum, or halves the bracket where that leaves it.
    Sources whose target is 0 or their cap get the flat rate 0 or `most`.
    """
    cells = sizes.filter("size > 0").groupBy("k", "size").agg(F.sum("times").alias("c"))
    cells = cells.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("size", "c"))).alias("cells"))
    ratio = F.try_divide("target", "source_size")
    state = goals.join(cells, "k", "left").withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9)))
    state = state.withColumn("flat", F.when(F.col("source_size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(ratio >= most * (1 - 1e-12), float(most)))
    z0 = F.get("cells", 0)["size"] / F.col("mean")
    lo, hi = F.least(F.lit(0.0), F.log(ratio) / z0), F.when(ratio > 1, F.log(F.lit(float(most))) / z0).otherwise(0.0)
    state = state.withColumn("begin", F.struct(F.lit(0.0).alias("lam"), lo.alias("lo"), hi.alias("hi"), F.lit(True).alias("open")))

    def gradient(lam: Column) -> Column:
        """The words that the rates of lam take, and the derivative of this."""

        def add(acc: Column, x: Column) -> Column:
            r = F.exp(lam * x["size"] / F.col("mean"))
            words_ = x["c"] * x["size"]
            return F.struct((acc["a"] + words_ * F.least(F.lit(float(most)), r)).alias("a"), (acc["d"] + F.when(r < most, words_ * x["size"] / F.col("mean") * r).otherwise(0.0)).alias("d"))

        return F.aggregate("cells", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("d")), add)

    def newton(st: Column, at: Column) -> Column:
        under = at["a"] < F.col("target")
        lo, hi = F.when(under, st["lam"]).otherwise(st["lo"]), F.when(under, st["hi"]).otherwise(st["lam"])
        step = st["lam"] - F.try_divide(at["a"], at["d"]) * F.log(at["a"] / F.col("target"))
        step = F.when((at["d"] > 0) & (step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        far = F.abs(at["a"] / F.col("target") - 1) > NEAR
        return F.struct(F.when(far, step).otherwise(st["lam"]).alias("lam"), lo.alias("lo"), hi.alias("hi"), far.alias("open"))

    # the gradient is bound to a variable of a lambda, so that it is summed once a step
    once = lambda st: F.get(F.transform(F.array(gradient(st["lam"])), lambda at: newton(st, at)), 0)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("begin"), lambda st, _: F.when(st["open"], once(st)).otherwise(st))
    # rounded, so that the last bits of sums in another order don't matter
    return state.select("k", "mean", F.when(F.col("flat").isNull(), F.round(found["lam"], 9)).alias("lam"), "flat")


def units(docs: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Distinct rows: _did, _th, k, doc_id, source, size, times, source_size, target, rate, copies (of all of them).

    Rows that agree in doc_id, text and source are one unit. It gets the whole
    part of its rate times its rows in copies, and one more if its place in a
    fixed random order, less the fraction, is under its source's cut; the cut
    is found digit by digit from sums, so that the source's words come nearest
    to the target. Up to two units a source then get or lose one copy where
    that comes nearer still. Units without words keep their rows.
    """
    sized = row_key(docs).select("_did", "_th", "doc_id", "source", source_key(), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = sized.groupBy("_did", "_th", "k").agg(F.min("doc_id").alias("doc_id"), F.min("source").alias("source"), F.min("size").alias("size"), F.count(F.lit(1)).alias("times"))
    sized = stored(sized, "mix-sizes")
    goals = stored(targets(sized, weights, share, most), "mix-targets")
    rated = sized.join(stored(tilted(sized, goals, most), "mix-tilt"), "k").withColumn("rate", rate(most)).drop("lam", "flat", "mean")
    u = F.call_function("shiftrightunsigned", F.xxhash64("_did", "_th", "k"), F.lit(11)) / float(1 << 53)
    due = F.col("rate") * F.col("times")
    base = F.floor(due).cast("long")
    rated = rated.withColumns({"base": base, "key": F.floor((u - (due - base) + 1) / 2 * DIGIT**ROUNDS).cast("long")})
    rated = stored(rated.withColumn("can", (F.col("base") < most * F.col("times")) & (due > F.col("base")) & (F.col("size") > 0)), "mix-rates")
    cut = rated.groupBy("k").agg(F.sum(F.col("base") * F.col("size")).alias("whole")).join(goals.select("k", "target"), "k").select("k", F.lit(0).cast("long").alias("cut"), (F.col("target") - F.col("whole")).alias("left"))
    cut = stored(cut, "mix-cut")
    for i in range(ROUNDS):
        unit = DIGIT ** (ROUNDS - 1 - i)
        within = rated.filter("can").join(cut, "k").filter(F.floor(F.col("key") / (unit * DIGIT)) == F.col("cut"))
        sums = within.groupBy("k", (F.floor(F.col("key") / unit)).alias("digit")).agg(F.sum("size").alias("sum"))
        upto = F.sum("sum").over(Window.partitionBy("k").orderBy("digit"))
        at = sums.withColumn("upto", upto).join(cut, "k").filter(F.col("upto") > F.col("left")).groupBy("k").agg(F.min(F.struct("digit", "upto", "sum")).alias("at"))
        past = F.col("at").isNull()  # every one of them is under the cut
        cut = cut.join(at, "k", "left").select("k", F.when(past, (F.col("cut") + 1) * DIGIT).otherwise(F.col("at.digit")).alias("cut"), F.when(past, F.lit(-1.0)).otherwise(F.col("left") - (F.col("at.upto") - F.col("at.sum"))).alias("left"))
        cut = stored(cut, "mix-cut")
    ties = rated.filter("can").join(cut, "k").filter(F.col("key") == F.col("cut")).groupBy("k").agg(F.sum("size").alias("tied"))
    cut = stored(cut.join(ties, "k", "left").select("k", F.when(2 * F.col("left") > F.col("tied"), F.col("cut") + 1).otherwise(F.col("cut")).alias("cut")), "mix-cut")
    rows = rated.join(cut, "k").withColumn("copies", F.when(F.col("size") == 0, F.col("times")).otherwise(F.col("base") + (F.col("can") & (F.col("key") < F.col("cut"))).cast("long")))
    rows = stored(rows.drop("cut", "can", "base", "key"), "mix-copies")
    moves = []
    for _ in range(2):
        now = rows
        for move in moves:
            now = moved(now, move)
        off = now.groupBy("k").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(goals.select("k", "target"), "k").select("k", (F.col("target") - F.col("taken")).alias("off"))
        off, up = stored(off, "mix-off"), F.col("off") > 0
        able = now.join(off, "k").filter((F.col("size") > 0) & F.when(up, F.col("copies") < most * F.col("times")).otherwise(F.col("copies") > 0))
        able = able.withColumn("then", F.abs(F.abs("off") - F.col("size"))).filter(F.col("then") < F.abs("off"))
        best = able.groupBy("k").agg(F.min(F.struct("then", F.xxhash64("_did", "_th").alias("r"), F.col("_did").alias("mdid"), F.col("_th").alias("mth"), F.when(up, 1).otherwise(-1).alias("by"))).alias("m"))
        moves.append(stored(best.select("k", "m.mdid", "m.mth", "m.by"), "mix-move"))
    for move in moves:
        rows = moved(rows, move)
    return rows.join(goals.select("k", "source_size", "target"), "k")


def source_key() -> Column:
    """k: the source with an s before it, or n for none."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("k")


def of_row() -> Column:
    """The copies of the unit's row that has the number _ord: its rows differ by one at most."""
    return F.floor(F.col("copies") / F.col("times")) + (F.col("_ord") < F.col("copies") % F.col("times")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = COPIES) -> DataFrame:
    """_did, _th, doc_id, source, size, source_size, target, rate, copies, taken.

    One row for each input row. size counts words, a null text has none; a
    null source is a source of its own, the last. Copies are found for all
    rows that agree in doc_id, text and source together (units) and dealt to
    these as evenly as they go, so that repeated rows come as near to the
    target as others. A document without words gets one copy. Columns besides
    doc_id, text and source are not read.
    """
    found = stored(units(docs, weights, share, most), "mix-units")
    blocks = found.filter("times > 1").withColumn("_b", F.explode(F.expr(f"sequence(0, (times - 1) div {BLOCK})"))).repartition("_did", "_th", "k", "_b")
    rows = blocks.withColumn("_ord", F.explode(F.expr(f"sequence(_b * {BLOCK}, least(times, (_b + 1) * {BLOCK}) - 1)"))).drop("_b")
    rows = found.filter("times = 1").withColumn("_ord", F.lit(0).cast("long")).unionByName(rows).withColumn("copies", of_row())
    return rows.select("_did", "_th", "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def moved(rows: DataFrame, move: DataFrame) -> DataFrame:
    """rows with one copy more or less where `move` says so."""
    here = (F.col("mdid") == F.col("_did")) & (F.col("mth") == F.col("_th"))
    return rows.join(move, "k", "left").withColumn("copies", F.col("copies") + F.when(here, F.col("by")).otherwise(0)).drop("mdid", "mth", "by")


def mixed(docs: DataFrame) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it."""
    key = ["_did", "_th", "k"]
    found = stored(units(docs, WEIGHTS, SHARE, COPIES).select(*key, "times", "copies"), "mix-units")
    keyed = row_key(docs).select("_row", "_did", "_th", source_key())
    rows = keyed.join(found.filter("times = 1 AND copies > 0"), key).select("_row", "copies")
    if not found.filter("times > 1").isEmpty():
        twins = numbered(keyed.join(found.filter("times > 1 AND copies > 0"), key), *key)
        rows = rows.unionByName(twins.select("_row", of_row().alias("copies")).filter("copies > 0"))
    return unpacked_rows(rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
