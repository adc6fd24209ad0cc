"""Near-dedup by similarity: SimHash and min-hash candidates, verified on the texts' shingles.

The 64-bit fingerprints of two texts with a Jaccard similarity of 0.8 differ in
about ten bits, far more than a trie join can search at any size. So the trie
self-join (budget 3) finds what is almost equal, and bands of min-hashes the
rest down to the border; no candidate counts before its similarity is computed.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, ship, stored, unpacked_rows
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import links, majority, shingles, spread

ship(__name__)

#: Words of a shingle, and the Jaccard similarity of shingle sets from which texts link, in percent.
SHINGLE, PERCENT = 5, 80
#: Min-hashes of a band, and bands. A pair at 0.8 shares a band with a chance of 0.98, one at 0.5 with 0.27.
HASHES, BANDS = 5, 10
#: Hubs of a bucket in the second turn, which are compared with all members of other groups.
HUBS = 8
#: Bits of a shingle set: each of its shingles turns one of them, so two sets differ in at least as many shingles as bits.
BITS = 512
#: Members of a bucket that meet as many others in one task.
CELL = 2048


def multipliers() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 2**63, HASHES * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def parity(h: np.ndarray) -> list[int]:
    """For each of BITS places whether an odd number of the hashes h falls on it, as longs."""
    odd = np.bincount((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signatures(docs: DataFrame, keep: tuple[str, ...], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keep and id, fp, n, bands, bits of each text.

    id is a 128-bit hash of its shingles in order: texts that agree in it are
    one class. fp: the SimHash of its shingles, n: the number of different
    ones, bands: a hash of each band's min-hashes, bits: the parity of these
    hashes' numbers at each of BITS places. A text without words has zeros and
    no bands.
    """

    def run(batches):
        import xxhash

        lanes, factors = spread(), multipliers()
        names = [*keep, "id", "fp", "n", "bands", "bits"]
        for batch in batches:
            made = []
            for t in batch.column(batch.num_columns - 1):
                found = shingles(t.as_py() or "", shingle)
                if not found:
                    made.append((bytes(16), 0, 0, [], [0] * (BITS // 64)))
                    continue
                raw = b"".join([xxhash.xxh64_digest(x, 42) for x in found])
                whole = xxhash.xxh3_128_digest(found[0] + raw)
                h = np.unique(np.frombuffer(raw, "<u8"))
                least = np.min([(h[at : at + 4096, None] * factors).min(axis=0) for at in range(0, len(h), 4096)], axis=0).astype("<u8")
                bands = [xxhash.xxh64_intdigest(least[i * HASHES : (i + 1) * HASHES].tobytes(), i) - (1 << 63) for i in range(BANDS)]
                made.append((whole, int.from_bytes(majority(np.frombuffer(raw, np.uint8).reshape(-1, 8), lanes), "big", signed=True), len(h), bands, parity(h)))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))] if made else [*batch.columns[:-1], *(pa.array([], k) for k in kinds)], names=names)

    kinds = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "id binary, fp long, n long, bands array<long>, bits array<long>"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, kinds)


def shingle_sets(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """id and s, the set of 64-bit hashes of its text's shingles; texts: id, text."""

    def run(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(x, 42) for x in shingles(t.as_py() or "", shingle)]), "<i8")) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))], names=["id", "s"])

    return texts.select("id", "text").mapInArrow(run, "id binary, s array<long>")


def similar(n: Column, m: Column, both: Column, percent: int = PERCENT) -> Column:
    """Sets of n and m elements that share `both` have the similarity or more."""
    return 100 * both >= percent * (n + m - both)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose shingle sets are similar.

    Each class that is in a pair has its set made once, from its least
    document; a pair joins two of these, so what is shuffled is in proportion
    to pairs.
    """
    asked = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(classes.select("id", "least.*"), "id")
    texts = docs.select("_did", "_th", "text").join(asked, ["_did", "_th"]).dropDuplicates(["id"])
    sets = stored(shingle_sets(texts, shingle), "neardup-sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    return stored(both.filter(similar(F.size("a"), F.size("b"), F.size(F.array_intersect("a", "b")), percent)).select("u", "v"), "neardup-links")


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of classes, the lesser id first."""
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def rest(cells: DataFrame, most: int, percent: int) -> DataFrame:
    """u, v, gap, more: for each u the `most` v of a cell that may be similar to it, the nearest by bits first.

    cells: key, i, j, asks, id, root, n, bits. Rows that ask are u, the others
    v, and only those of different roots meet. more: u has others in this cell.
    """

    def run(found: pa.Table) -> pa.Table:
        asks, n = found.column("asks").to_numpy(zero_copy_only=False), found.column("n").to_numpy()
        ids = np.array(found.column("id").to_pylist(), object)
        bits = found.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        _, root = np.unique(np.array(found.column("root").to_pylist(), object), return_inverse=True)
        _, rank = np.unique(ids, return_inverse=True)
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        made: list[tuple] = []
        for at in range(0, len(left), 256):
            u = left[at : at + 256]
            gap = np.zeros((len(u), len(right)), np.int64)
            for w in range(BITS // 64):
                gap += np.bitwise_count(bits[u, w][:, None] ^ bits[right, w][None])
            both = n[u][:, None] + n[right][None]
            gap = np.maximum(gap, np.abs(n[u][:, None] - n[right][None]))
            ok = ((100 + percent) * gap <= (100 - percent) * both) & (root[u][:, None] != root[right][None])
            for k in np.flatnonzero(ok.any(axis=1)):
                v = np.flatnonzero(ok[k])
                part = gap[k, v] / both[k, v]
                order = np.lexsort((rank[right[v]], part))[:most]
                made += [(ids[u[k]], ids[right[v[o]]], float(part[o]), len(v) > most) for o in order]
        columns = zip(*made, strict=True) if made else ([], [], [], [])
        return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, (pa.binary(), pa.binary(), pa.float64(), pa.bool_()), strict=True)], names=["u", "v", "gap", "more"])

    return cells.groupBy("key", "i", "j").applyInArrow(run, "u binary, v binary, gap double, more boolean")


def near_links(classes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """u, v: verified links that connect classes as all similar pairs of all buckets do; classes: id, least, fp, n, bands, bits.

    Classes that share a band are a bucket, and so are those whose fingerprints
    the trie join connects. Pairs of a bucket are settled when they are
    compared, when links connect them already, or when their bits, which differ
    in no more places than their shingle sets, show that they can't be similar.
    Nothing else is left out:

    First the member with the most neighbours over all its buckets is the
    bucket's hub, and all others are compared with it. Then up to HUBS members
    outside the largest group of the bucket are compared with all members of
    other groups: a bucket with no more of them is settled by that. In other
    buckets the members outside the largest group meet all members in cells of
    about CELL times CELL, and each of them is compared with the nearest of
    other groups, in turns of ever more until no cell has more. So the pairs of
    a group of near copies are looked at by their bits at most; texts are
    compared in proportion to members and to pairs that only texts can tell
    apart.
    """
    side = classes.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("bits").alias("also"))
    gap = F.greatest(reduce(add, (F.bit_count(F.get("bits", i).bitwiseXOR(F.get("also", i))) for i in range(BITS // 64))), F.abs(F.col("n") - F.col("m")))
    able = (100 + percent) * gap <= (100 - percent) * (F.col("n") + F.col("m"))
    prints = stored(classes.select("fp").distinct(), "neardup-prints")
    trunks = connected_components(links(prints)).withColumnRenamed("v", "fp")
    trunk = classes.select("id", "fp").join(trunks, "fp", "left").select("id", F.xxhash64(F.coalesce("root", "fp"), F.lit(-1)).alias("key"))
    members = stored(classes.select("id", F.explode("bands").alias("key")).unionByName(trunk), "neardup-members")
    members = stored(members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "key"), "neardup-members")
    score = members.groupBy("id").agg(F.sum("c").alias("score"))
    members = stored(members.join(score, "id").join(classes.select("id", "n", "bits"), "id"), "neardup-members")
    roots = members.select("id", F.col("id").alias("root")).distinct()
    edges = done = classes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    turn, most = 0, 1
    while not members.isEmpty():
        # of the buckets that links don't connect whole, the members with their groups; main: the largest one
        placed = members.join(roots, "id") if turn else members.withColumn("root", F.col("id"))
        groups = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("score", F.col("id").alias("top"))).alias("t"))
        heads = groups.groupBy("key").agg(F.max(F.struct("k", "t", "root")).alias("x"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("q")).filter("q > 1")
        heads = heads.select("key", F.col("x.root").alias("main"), "all", (F.col("all") - F.col("x.k")).alias("out"))
        placed = stored(placed.join(heads, "key"), "neardup-placed")
        again = False
        if turn < 2:
            outer = placed.filter("root <> main" if turn else "root = main")
            rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
            hubs = outer.select("key", "id", "root", "score").withColumn("r", rank).filter(F.col("r") <= (HUBS if turn else 1)).select("key", F.col("id").alias("hub"), F.col("root").alias("own"))
            hubs = stored(hubs.join(side, "hub"), "neardup-hubs")
            meet = placed.join(hubs, "key").filter((F.col("root") != F.col("own")) & able).select(F.col("id").alias("u"), F.col("hub").alias("v"))
            new = ordered(meet)
        else:
            many = lambda c: F.ceil(F.col(c) / CELL).cast("int")
            deal = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), many(c)).cast("int")
            to_all = lambda c: F.explode(F.sequence(F.lit(0), many(c) - 1))
            cut = ("id", "root", "n", "bits")
            asking = placed.filter("root <> main").select("key", deal("out", 1).alias("i"), to_all("all").alias("j"), F.lit(True).alias("asks"), *cut)
            asked = placed.select("key", to_all("out").alias("i"), deal("all", 2).alias("j"), F.lit(False).alias("asks"), *cut)
            found = stored(rest(asking.unionByName(asked), most, percent), "neardup-rest")
            again = not found.filter("more").isEmpty()
            ranked = found.groupBy(F.col("u").alias("asker"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("gap").alias("gap")).join(done, ["u", "v"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy("gap", "u", "v")))
            ranked = stored(ranked.filter(F.col("r") <= most + 1), "neardup-ranked")
            again = again or not ranked.filter(F.col("r") > most).isEmpty()
            new = ranked.filter(F.col("r") <= most).select("u", "v").distinct()
        new = stored(new.join(done, ["u", "v"], "left_anti"), "neardup-pairs")
        linked = verified(new, classes, docs, shingle, percent)
        done, edges = done.unionByName(new), edges.unionByName(linked)
        if turn == 0:
            roots = regrouped(roots, linked)
        elif turn == 1:
            left = placed.filter(F.col("out") > HUBS).select("key").distinct()
            members, roots = stored(members.join(left, "key", "left_semi"), "neardup-members"), regrouped(roots, linked)
        elif again:
            roots, most = regrouped(roots, linked), most * 8
        else:
            break
        turn += 1
    return edges


def regrouped(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """id, root after adding links (u, v) of ids to groups."""
    ends = linked.join(roots.select(F.col("id").alias("u"), F.col("root").alias("a")), "u").join(roots.select(F.col("id").alias("v"), F.col("root").alias("b")), "v")
    moved = connected_components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("v").alias("root"), F.col("root").alias("least"))
    return stored(roots.join(moved, "root", "left").select("id", F.coalesce("least", "root").alias("root")), "neardup-roots")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, all columns: of each group of near copies the row with the least (doc_id, text hash).

    Texts link if their shingle sets have a Jaccard similarity of `percent` or
    more; what links connect is one group. Texts of the same words are equal,
    those without words too (a null text is empty). Fewer than `shingle` words
    are one shingle. doc_id null is the last; of repeated rows one stays.
    """
    keyed = row_key(docs)
    rows = stored(signatures(keyed, ("_did", "_th"), "text", shingle), "neardup-rows")
    classes = rows.groupBy("id").agg(F.min(F.struct("_did", "_th")).alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("bits").alias("bits"))
    classes = stored(classes, "neardup-classes")
    roots = stored(connected_components(near_links(classes, keyed, shingle, percent)), "neardup-roots").withColumnRenamed("v", "id")
    firsts = classes.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("least").alias("first"))
    firsts = stored(firsts.select("first.*"), "neardup-kept")
    kept = keyed.join(firsts, ["_did", "_th"], "left_semi")
    twice = rows.groupBy("_did", "_th").count().filter("count > 1")
    return unpacked_rows(kept if twice.isEmpty() else kept.dropDuplicates(["_did", "_th"]), docs.columns)
