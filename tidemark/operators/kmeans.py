"""K-means over many weeks and many k at once, and choices of k.

Lloyd's steps run for all weeks, cluster numbers and restarts together: a task
assigns its rows to the nearest centres and returns one partial sum for each
centre, which are added up by key. No week ever meets in one task, however
large. Equal vectors of a week are one row with a count. First centres are
drawn from all of these, one after the other, by squared distance. The same
steps are run in one task for weeks whose vectors fit into it, a task for each
week and cluster number, which spares a job a step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Restarts, steps, and bytes of centres of one block of weeks.
INITS, STEPS, CENTRE_BYTES = 10, 100, 64 << 20
TOLERANCE = 1e-4
#: Rows of a block within a task, and silhouettes that count as equal.
ROWS, EQUAL = 2048, 1e-12
#: Bytes of different vectors up to which a week is fitted in one task.
TASK_BYTES = 64 << 20


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None], 0)
    return d.argmin(axis=1), d.min(axis=1)


def uniform(h: np.ndarray, turn: int) -> np.ndarray:
    """A number in (0, 1) for each hash and turn, the same wherever the row is."""
    z = h + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(12)).astype(float) * 2.0**-52 + 2.0**-53


def padded(centres: np.ndarray, k: int) -> np.ndarray:
    """k centres: a week with fewer vectors repeats its first one."""
    return np.vstack([centres[:k], np.repeat(centres[:1], max(0, k - len(centres)), axis=0)])


def apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances by subtraction: those of a centre's own row are zero."""
    out = np.empty(len(x))
    for at in range(0, len(x), ROWS):
        d = x[at : at + ROWS] - centre
        out[at : at + ROWS] = np.einsum("ij,ij->i", d, d)
    return out


def drawn(x: np.ndarray, n: np.ndarray, h: np.ndarray, k: int, i: int) -> np.ndarray:
    """The first centres of restart i."""
    found, d = [], np.ones(len(x))
    for j in range(k):
        with np.errstate(divide="ignore"):
            race = -np.log(uniform(h, i << 20 | j)) / (n * d)
        if not np.isfinite(race.min()):
            break
        found.append(x[race.argmin()])
        if j < k - 1:
            far = apart(x, found[-1])
            d = np.minimum(d, far) if j else far
    return padded(np.array(found), k)


def step(x: np.ndarray, square: np.ndarray, n: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, sizes and sums of several restarts' centres, which are (restart, k, dim); rows go through in blocks that a cache holds."""
    count, k, dim = centres.shape
    flat = centres.reshape(count * k, dim)
    twice, own, first = -2 * flat.T, (flat**2).sum(axis=1), np.arange(count) * k
    cost, size, sums = np.zeros(count), np.zeros(count * k), np.zeros((count * k, dim))
    for at in range(0, len(x), ROWS):
        part, times = x[at : at + ROWS], n[at : at + ROWS]
        d = part @ twice + own
        place = d.reshape(len(part), count, k).argmin(axis=2) + first
        cost += times @ np.maximum(np.take_along_axis(d, place, axis=1) + square[at : at + ROWS, None], 0)
        hot = np.zeros((len(part), count * k))
        np.put_along_axis(hot, place, times[:, None], axis=1)
        size += hot.sum(axis=0)
        sums += hot.T @ part
    return cost, size.reshape(count, k), sums.reshape(count, k, dim)


def fit_one(x: np.ndarray, n: np.ndarray, h: np.ndarray, k: int, inits: int, steps: int) -> tuple[float, np.ndarray]:
    """Inertia and centres of the best restart for the vectors x, their numbers n and hashes h."""
    state = np.stack([drawn(x, n, h, k, i) for i in range(inits if k > 1 else 1)])
    square, inertia, active = (x**2).sum(axis=1), np.full(len(state), np.inf), np.arange(len(state))
    for _ in range(steps):
        if not len(active):
            break
        cost, size, sums = step(x, square, n, state[active])
        state[active] = np.where(size[..., None] > 0, sums / np.maximum(size, 1)[..., None], state[active])
        moving = inertia[active] - cost > TOLERANCE * np.maximum(cost, 1e-12)
        inertia[active] = cost
        active = active[moving]
    best = int(inertia.argmin())
    return float(inertia[best]), state[best]


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(axis=1))[:, None]
    return x / np.where(size > 0, size, 1)


def silhouettes(u: np.ndarray, label: np.ndarray, num: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Cosine silhouettes of unit vectors, from the sizes and sums of all clusters, as in functions/vectors.py."""
    used = np.flatnonzero(num > 0)
    own, m = np.searchsorted(used, label), num[used]
    near, rows = u @ sums[used].T, np.arange(len(u))
    a = (m[own] - near[rows, own]) / np.maximum(m[own] - 1, 1)
    other = 1 - near / m
    other[rows, own] = np.inf
    b = other.min(axis=1)
    return np.where(m[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))


def score_one(x: np.ndarray, n: np.ndarray, centres: np.ndarray) -> float | None:
    """The mean silhouette of all rows, None with one cluster."""
    u, label = unit(x), nearest(x, centres)[0]
    hot = np.zeros((len(centres), len(x)))
    hot[label, np.arange(len(x))] = n
    num = hot.sum(axis=1)
    return float(n @ silhouettes(u, label, num, hot @ u) / n.sum()) if (num > 0).sum() > 1 else None


def _fit_small(rows: DataFrame, grid: list[tuple[str, int]], seed: int, inits: int, steps: int, scored: bool = False) -> dict:
    """(week, k) -> (inertia, centres, silhouette) for weeks that fit a task each."""
    asked = F.broadcast(rows.sparkSession.createDataFrame(grid, "week string, k int"))  # a row for each fit of a block

    def run(found: pa.Table) -> pa.Table:
        h = found.column("h").to_numpy()
        by, week, k = np.argsort(h, kind="stable"), found.column("week")[0].as_py(), found.column("k")[0].as_py()
        x = found.column("vector").combine_chunks().flatten().to_numpy().reshape(len(h), -1)[by]
        n = found.column("n").to_numpy()[by].astype(float)
        cost, centres = fit_one(x, n, h[by].view(np.uint64), k, inits, steps)
        score = score_one(x, n, centres) if scored else None
        return pa.table([pa.array([v], t) for v, t in ((week, pa.string()), (k, pa.int32()), (cost, pa.float64()), (score, pa.float64()), (centres.tolist(), pa.list_(pa.list_(pa.float64()))))], names=["week", "k", "cost", "score", "centres"])

    each = rows.select("week", "vector", "n", F.xxhash64("vector", F.lit(seed)).alias("h")).join(asked, "week")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt = each.repartition(max(cores, min(4 * len(grid), 8 * cores)), "week", "k")
    made = dealt.groupBy("week", "k").applyInArrow(run, "week string, k int, cost double, score double, centres array<array<double>>").collect()
    return {(r["week"], r["k"]): (r["cost"], np.array(r["centres"]), r["score"]) for r in made}


def first_centres(rows: DataFrame, counts: dict[str, int], seed: int, inits: int) -> dict:
    """(week, init) -> counts[week] centres far apart, or a centre for each vector if these are fewer.

    Each is drawn from all rows by squared distance to those before, times n:
    the row with the least exponential number of that rate wins, so a task
    returns one row for each week and restart. The first k are those for k.
    """
    found: dict = {}
    hashed = rows.select("week", "vector", "n", F.xxhash64("vector", F.lit(seed)).alias("h"))
    for j in range(max(counts.values())):
        shared = rows.sparkSession.sparkContext.broadcast({(w, i): found.get((w, i)) for w, k in counts.items() for i in range(inits) if j < k and (j == 0 or len(found.get((w, i), ())) == j)})

        def draw(batches, j=j, shared=shared):
            best: dict = {}
            for pdf in batches:
                for week, part in pdf.groupby("week"):
                    x = np.stack(part["vector"].to_numpy()).astype(float)
                    n, h = part["n"].to_numpy(float), part["h"].to_numpy(np.int64).view(np.uint64)
                    for (w, i), centres in shared.value.items():
                        if w == week:
                            # distances by subtraction: those of a centre's own row are zero
                            d = np.ones(len(x)) if centres is None else np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
                            with np.errstate(divide="ignore"):
                                race = -np.log(uniform(h, i << 20 | j)) / (n * d)
                            at = int(race.argmin())
                            if np.isfinite(race[at]) and race[at] < best.get((w, i), (np.inf,))[0]:
                                best[(w, i)] = (race[at], x[at].tolist())
            yield pd.DataFrame([(w, i, r, v) for (w, i), (r, v) in best.items()], columns=["week", "init", "race", "vector"])

        drawn = hashed.mapInPandas(draw, "week string, init int, race double, vector array<double>").groupBy("week", "init").agg(F.min(F.struct("race", "vector")).alias("b")).collect()
        for r in drawn:
            old = found.get((r["week"], r["init"]))
            new = np.array([r["b"]["vector"]])
            found[(r["week"], r["init"])] = new if old is None else np.vstack([old, new])
        shared.unpersist()
    return found


def _score_block(rows: DataFrame, centres: dict) -> dict:
    """(week, k) -> the mean silhouette, for one block of weeks: cluster sums in one job, silhouettes in the next."""
    dim = len(next(iter(centres.values()))[0])
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def sums(batches):
        found: dict = {}
        for pdf in batches:
            for week, part in pdf.groupby("week"):
                x, n = np.stack(part["vector"].to_numpy()).astype(float), part["n"].to_numpy(float)
                u = unit(x)
                for (w, k), c in shared.value.items():
                    if w == week:
                        hot = np.zeros((len(c), len(x)))
                        hot[nearest(x, c)[0], np.arange(len(x))] = n
                        new = np.column_stack([hot.sum(axis=1), hot @ u])
                        found[(w, k)] = found[(w, k)] + new if (w, k) in found else new
        yield pd.DataFrame([(w, k, j, r.tolist()) for (w, k), m in found.items() for j, r in enumerate(m)], columns=["week", "k", "label", "sums"])

    parts = rows.mapInPandas(sums, "week string, k int, label int, sums array<double>").groupBy("week", "k", "label").agg(*(F.sum(F.get("sums", d)).alias(f"_{d}") for d in range(dim + 1)))
    total = {c: np.zeros((len(m), dim + 1)) for c, m in centres.items()}
    for r in parts.select("week", "k", "label", F.array(*(F.col(f"_{d}") for d in range(dim + 1))).alias("sums")).collect():
        total[(r["week"], r["k"])][r["label"]] = r["sums"]
    totals = rows.sparkSession.sparkContext.broadcast({c: m for c, m in total.items() if (m[:, 0] > 0).sum() > 1})

    def values(batches):
        found: dict = {}
        for pdf in batches:
            for week, part in pdf.groupby("week"):
                x, n = np.stack(part["vector"].to_numpy()).astype(float), part["n"].to_numpy(float)
                u = unit(x)
                for (w, k), m in totals.value.items():
                    if w == week:
                        found[(w, k)] = found.get((w, k), 0.0) + float(n @ silhouettes(u, nearest(x, shared.value[(w, k)])[0], m[:, 0], m[:, 1:]))
        yield pd.DataFrame([(w, k, v) for (w, k), v in found.items()], columns=["week", "k", "value"])

    added = rows.mapInPandas(values, "week string, k int, value double").groupBy("week", "k").agg(F.sum("value").alias("value")).collect()
    shared.unpersist()
    totals.unpersist()
    return {(r["week"], r["k"]): r["value"] / total[(r["week"], r["k"])][:, 0].sum() for r in added}


def _fit_block(rows: DataFrame, grid: list[tuple[str, int]], seed: int, inits: int, steps: int, scored: bool = False) -> dict:
    """(week, k) -> (inertia, centres, silhouette) for one block of weeks; rows: week, vector, n."""
    spark = rows.sparkSession
    most: dict[str, int] = {}
    for week, k in grid:
        most[week] = max(k, most.get(week, 0))
    found = first_centres(rows, most, seed, inits)
    dim = rows.select(F.size("vector")).first()[0]
    state = {(w, k, i): padded(found[(w, i)], k) for w, k in grid for i in range(inits if k > 1 else 1)}
    inertia = dict.fromkeys(state, np.inf)
    active = set(state)
    for _ in range(steps):
        if not active:
            break
        shared = spark.sparkContext.broadcast({c: state[c] for c in active})

        def partial(batches, shared=shared):
            sums: dict = {}
            for pdf in batches:
                for week, part in pdf.groupby("week"):
                    x, n = np.stack(part["vector"].to_numpy()).astype(float), part["n"].to_numpy(float)
                    for (w, k, i), centres in shared.value.items():
                        if w == week:
                            label, d = nearest(x, centres)
                            hot = np.zeros((len(centres), len(x)))
                            hot[label, np.arange(len(x))] = n
                            new = (hot.sum(axis=1), hot @ x, np.bincount(label, d * n, minlength=len(centres)))
                            old = sums.get((w, k, i))
                            sums[(w, k, i)] = new if old is None else tuple(a + b for a, b in zip(old, new, strict=True))
            yield pd.DataFrame([(w, k, i, j, n[j], s[j].tolist(), e[j]) for (w, k, i), (n, s, e) in sums.items() for j in range(len(n))], columns=["week", "k", "init", "label", "n", "sums", "cost"])

        parts = rows.mapInPandas(partial, "week string, k int, init int, label int, n double, sums array<double>, cost double")
        added = parts.groupBy("week", "k", "init", "label").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *(F.sum(F.get("sums", d)).alias(f"_{d}") for d in range(dim)))
        cost: dict = {}
        for r in added.select("week", "k", "init", "label", "n", "cost", F.array(*(F.col(f"_{d}") for d in range(dim))).alias("sums")).collect():
            c = (r["week"], r["k"], r["init"])
            cost[c] = cost.get(c, 0.0) + r["cost"]
            if r["n"] > 0:
                state[c][r["label"]] = np.array(r["sums"]) / r["n"]
        shared.unpersist()
        active = {c for c in active if inertia[c] - cost[c] > TOLERANCE * max(cost[c], 1e-12)}
        inertia |= cost
    best: dict = {}
    for (w, k, i), centres in state.items():
        if (w, k) not in best or (inertia[(w, k, i)], i) < best[(w, k)][:2]:
            best[(w, k)] = (inertia[(w, k, i)], i, centres)
    scores = _score_block(rows, {c: centres for c, (_, _, centres) in best.items()}) if scored else {}
    return {c: (e, centres, scores.get(c)) for c, (e, _, centres) in best.items()}


def counted(df: DataFrame) -> DataFrame:
    """week, vector, n: the different vectors of each week; df: week, vector, and n if its rows stand for several."""
    n = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.groupBy("week", F.col("vector").cast("array<double>").alias("vector")).agg(n.alias("n"))


def fit(df: DataFrame, ks: dict[str, list[int]], seed: int = 42, inits: int = INITS, steps: int = STEPS, task_bytes: int = TASK_BYTES) -> dict:
    """(week, k) -> (inertia, centres); df: week, vector; ks: cluster numbers by week."""
    rows = counted(df).filter(F.col("week").isin([w for w, found in ks.items() if found])).persist()
    try:
        return {c: m[:2] for c, m in fitted(rows, ks, seed, inits, steps, task_bytes).items()}
    finally:
        rows.unpersist()


def fitted(rows: DataFrame, ks: dict[str, list[int]], seed: int, inits: int, steps: int = STEPS, task_bytes: int = TASK_BYTES, scored: bool = False) -> dict:
    """(week, k) -> (inertia, centres, silhouette if scored); rows: those of counted(), which are read several times.

    Weeks are taken in blocks whose centres stay under CENTRE_BYTES, for these
    are sent to every task or come from them.
    """
    rows = rows.filter(F.col("week").isin([w for w, found in ks.items() if found]))
    sizes = {r["week"]: r["bytes"] for r in rows.groupBy("week").agg(F.sum(8 * F.size("vector")).alias("bytes")).collect()}
    dim = (rows.select(F.size("vector")).first() or [1])[0]
    small = {w for w in ks if sizes.get(w, 0) <= task_bytes}
    out: dict = {}
    for chosen, run, each in ((small, _fit_small, 1), (set(ks) - small, _fit_block, inits)):
        block: list[tuple[str, int]] = []
        size = 0
        for week, k in [(w, k) for w, found in ks.items() if w in chosen for k in found]:
            need = k * each * dim * 8
            if block and size + need > CENTRE_BYTES:
                out |= run(rows, block, seed, inits, steps, scored)
                block, size = [], 0
            block.append((week, k))
            size += need
        out |= run(rows, block, seed, inits, steps, scored) if block else {}
    return out


def assign(df: DataFrame, centres: dict[str, np.ndarray], vector: str = "vector") -> DataFrame:
    """df with label: the nearest of its week's centres."""
    shared = df.sparkSession.sparkContext.broadcast({w: np.asarray(c, float) for w, c in centres.items()})

    @F.pandas_udf("int")
    def label(week: pd.Series, vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(week), np.int32)
        for w in week.unique():
            here = (week == w).to_numpy()
            out[here] = nearest(np.stack(vectors[here].to_numpy()).astype(float), shared.value[w])[0]
        return pd.Series(out)

    return df.filter(F.col("week").isin(list(centres))).withColumn("label", label("week", vector))


def week_sizes(df: DataFrame, least: int) -> dict[str, int]:
    """Rows of each kept week: a row a week."""
    return {r["week"]: r["count"] for r in df.groupBy("week").count().filter(F.col("count") >= least).orderBy("week").collect()}


def pick_by_silhouette(df: DataFrame, k_min: int = 2, k_max: int = 10, least: int = 5, seed: int = 42, inits: int = INITS, task_bytes: int = TASK_BYTES) -> dict[str, int]:
    """The k with the best cosine silhouette for each week; the first of equal ones.

    df: week, vector, and n if its rows stand for several. Silhouettes are found
    where the fits are, from different vectors and their numbers; rows of df are
    read once.
    """
    rows = counted(df.dropna(subset=["week", "vector"])).persist()
    try:
        found = rows.groupBy("week").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy("week").collect()
        sizes = {r["week"]: r["n"] for r in found}
        ks = {w: list(range(k_min, min(k_max, n) + 1)) for w, n in sizes.items() if n > k_min}
        models = fitted(rows, ks, seed, inits, task_bytes=task_bytes, scored=True)
    finally:
        rows.unpersist()
    picked = {w: max(1, n) for w, n in sizes.items() if n <= k_min}
    for w, tried in ks.items():
        best = (-1.0, k_min)
        for k in tried:
            score = models[(w, k)][2]
            if score is not None and score > best[0] + EQUAL:
                best = (score, k)
        picked[w] = best[1]
    return picked


def elbow_table(df: DataFrame, k_min: int = 2, k_max: int = 10, least: int = 5, seed: int = 42, inits: int = INITS) -> DataFrame:
    """week, k, wss for k from k_min to under the week's size."""
    sizes = week_sizes(df, least)
    ks = {w: list(range(k_min, min(k_max + 1, n))) for w, n in sizes.items()}
    models = fit(df, ks, seed, inits)
    return df.sparkSession.createDataFrame([(w, k, float(e)) for (w, k), (e, _) in sorted(models.items())], "week string, k int, wss double")


def elbow_picks(table: DataFrame) -> DataFrame:
    """week, k: where the second difference of wss is largest, ends excluded; the first of equal ones.

    With fewer than three values the first k.
    """
    w = Window.partitionBy("week").orderBy("k")
    bend = table.withColumns({"bend": F.lag("wss").over(w) - 2 * F.col("wss") + F.lead("wss").over(w), "points": F.count(F.lit(1)).over(Window.partitionBy("week"))})
    order = Window.partitionBy("week").orderBy(F.when(F.col("points") >= 3, F.col("bend")).desc_nulls_last(), "k")
    return bend.withColumn("r", F.row_number().over(order)).filter("r = 1").select("week", "k", F.round("bend", 6).alias("bend"))


def elbow_curve(table: DataFrame) -> DataFrame:
    """week, k, wss, is_elbow: the curves that a plot would show."""
    picked = elbow_picks(table).select("week", "k", F.lit(True).alias("is_elbow"))
    return table.join(picked, ["week", "k"], "left").withColumn("is_elbow", F.coalesce("is_elbow", F.lit(False)))


def cluster_weeks(df: DataFrame, k: int | dict[str, int] = 6, least: int | None = None, seed: int = 42, inits: int = INITS) -> DataFrame:
    """df, of the kept weeks, with label. A week is kept with max(5, k) rows, or `least`."""
    sizes = week_sizes(df, least if least is not None else max(5, k if isinstance(k, int) else 5))
    ks = {w: [min(k if isinstance(k, int) else k.get(w, 6), n)] for w, n in sizes.items()}
    models = fit(df, ks, seed, inits)
    return assign(df, {w: c for (w, _), (_, c) in models.items()})
