"""SimHash near-dedup: fingerprints, and a binary trie self-join of them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored, table
from tidemark.llm.components import connected_components

ship(__name__)

#: Words of a shingle, and differing bits up to which fingerprints link.
SHINGLE, BUDGET = 3, 3
#: Fingerprints that one task joins, on average, and node pairs that it holds at once.
TASK_ROWS, CHUNK = 100_000, 1 << 18
#: Fingerprints below a node at which the join begins, on average, and code pairs that end it.
NODE_ROWS, LEAF = 256, 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def spread() -> np.ndarray:
    """For each byte its eight bits, the highest first, as the bytes of a 64-bit number."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingles(text: str, shingle: int) -> list[bytes]:
    """A text's runs of `shingle` words, A-Z lower-cased, repeats included; a shorter text's words; none of no words."""
    words = text.encode().translate(LOWER).split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[s:e] for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def majority(raw: np.ndarray, lanes: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes, which are the rows of raw."""
    n, width = raw.shape
    counts = np.zeros(8 * width, np.int64)
    for at in range(0, n, 255 * 256):  # a byte lane counts to 255
        part = lanes[raw[at : at + 255 * 256]]
        full = np.zeros((-(-len(part) // 255) * 255, width), np.uint64)
        full[: len(part)] = part
        counts += full.reshape(-1, 255, width).sum(axis=1).view(np.uint8).reshape(-1, 8 * width).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keep and fp, the fingerprint as a signed long; that of a text without words is 0.

    The shingles' hashes are XXH64 with seed 42.
    """

    def run(batches):
        import xxhash

        lanes = spread()
        for batch in batches:
            made = []
            for t in batch.column(batch.num_columns - 1):
                found = shingles(t.as_py() or "", shingle)
                made.append(majority(np.frombuffer(b"".join([xxhash.xxh64_digest(x, 42) for x in found]), np.uint8).reshape(-1, 8), lanes) if found else bytes(8))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.frombuffer(b"".join(made), ">i8").astype(np.int64))], names=[*keep, "fp"])

    kinds = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "fp long"])
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, kinds)


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (the least member of each component) after adding the edges a-b."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return labels
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(labels, up := labels[labels]):
            labels = up


def trie_links(codes: np.ndarray, top: int, budget: int) -> np.ndarray:
    """For each of the sorted codes the least one connected with it, by index.

    The sorted array is a binary trie: a node at depth d is a range of codes
    that agree in d bits. Pairs of nodes go down together, from each node at
    depth `top` with itself; a pair whose two sides part at a bit has spent one
    of the budget, and is dropped beyond it. Pairs whose codes are all in one
    component already have nothing to add and are dropped as well, so that a
    dense group costs no square. Pairs wait on a stack in bounded chunks.
    """
    n = len(codes)
    labels = np.arange(n)
    heads = np.flatnonzero(np.concatenate([[True], (codes[1:] ^ codes[:-1]) >> np.uint64(64 - top) != 0])) if top else np.array([0])
    tails = np.concatenate([heads[1:], [n]])
    many = tails - heads > 1
    heads, tails = heads[many], tails[many]
    stack = [(top, heads, tails, heads, tails, np.zeros(len(heads), np.int8))]
    while stack:
        depth, a, b, c, d, err = stack.pop()
        if len(a) > CHUNK:
            half = len(a) // 2
            stack.append((depth, a[half:], b[half:], c[half:], d[half:], err[half:]))
            stack.append((depth, a[:half], b[:half], c[:half], d[:half], err[:half]))
            continue
        turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        same = (turns[a] == turns[b - 1]) & (turns[c] == turns[d - 1]) & (labels[a] == labels[c])
        a, b, c, d, err = (x[~same] for x in (a, b, c, d, err))
        small = (b - a) * (d - c) <= LEAF
        if small.any():
            wide = (d - c)[small]
            sizes = (b - a)[small] * wide
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            k = np.arange(len(first)) - first
            wide = np.repeat(wide, sizes)
            x, y = np.repeat(a[small], sizes) + k // wide, np.repeat(c[small], sizes) + k % wide
            near = (np.bitwise_count(codes[x] ^ codes[y]) <= budget) & (x != y)
            labels = merged(labels, x[near], y[near])
            a, b, c, d, err = (x[~small] for x in (a, b, c, d, err))
        if not len(a):
            continue
        shift, one = np.uint64(max(0, 63 - depth)), np.int8(1)
        cut = lambda lo, hi: np.clip(np.searchsorted(codes, ((codes[lo] >> shift) | np.uint64(1)) << shift), lo, hi)
        p, q, own = cut(a, b), cut(c, d), a == c
        down = [(a, p, c, q, err, None), (p, b, q, d, err, None), (a, p, q, d, err + one, None), (p, b, c, q, err + one, ~own)]
        kids = [[], [], [], [], []]
        for lo1, hi1, lo2, hi2, e, only in down:
            ok = (lo1 < hi1) & (lo2 < hi2) & (e <= budget) & ((lo1 != lo2) | (hi1 - lo1 > 1))
            if only is not None:
                ok &= only
            for kid, x in zip(kids, (lo1, hi1, lo2, hi2, e), strict=True):
                kid.append(x[ok])
        kids = [np.concatenate(k) for k in kids]
        if len(kids[0]):
            stack.append((depth + 1, *kids))
    return labels


def links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """u, v: edges that connect fingerprints as all links do; classes: fp, distinct.

    Two fingerprints within the budget agree in all but `budget` of any blocks
    that the bits are cut into, so both lie below one node of the trie whose
    first levels are the bits of some blocks. There is one such trie for each
    choice of blocks; its nodes at that level are dealt out to tasks, and a
    task joins each of its nodes with itself. With more fingerprints more
    blocks are cut, which keeps nodes small: with a budget of 3, 4 tries up to
    16 million, and 10 up to 10 billion. A task returns no more edges than
    fingerprints.
    """
    count = classes.count()
    blocks = budget + 1
    while blocks < 64 and count / 2 ** (64 * (blocks - budget) / blocks) > NODE_ROWS:
        blocks += 1
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - budget):
        bits = [i for c in chosen for i in range(cuts[c], cuts[c + 1])]
        masks.append((bits, sum(1 << (63 - i) for i in bits)))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    parts = max(1, -(-count // TASK_ROWS))  # of each choice of blocks
    array = F.array(*(F.lit(signed(m)).cast("long") for _, m in masks))
    keyed = classes.select("fp", F.posexplode(array).alias("t", "mask"))
    keyed = keyed.select("fp", "t", F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "t"), F.lit(parts)).alias("part"))

    def join(found: pa.Table) -> pa.Table:
        bits = masks[found.column("t")[0].as_py()][0]
        given = found.column("fp").to_numpy().view(np.uint64)
        order = [*bits, *(i for i in range(64) if i not in bits)]
        codes = np.zeros(len(given), np.uint64)
        at = 0
        while at < 64:  # runs of bits that stay together move at once
            run = 1
            while at + run < 64 and order[at + run] == order[at] + run:
                run += 1
            piece = (given >> np.uint64(64 - order[at] - run)) & np.uint64((1 << run) - 1)
            codes |= piece << np.uint64(64 - at - run)
            at += run
        by = np.argsort(codes, kind="stable")
        labels = trie_links(codes[by], len(bits), budget)
        ids = given[by].view(np.int64)
        moved = labels != np.arange(len(labels))
        return pa.table({"u": ids[moved], "v": ids[labels[moved]]})

    return keyed.groupBy("t", "part").applyInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), first: Column | None = None, text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """keep, fp, component and first: the row's component and its least `first`.

    Every row is in one component, alone if nothing links to it; component is
    one of its fingerprints. A null text is an empty one; empty texts share a
    fingerprint of zeros and link like any other. Equal fingerprints are one
    class and never paired: a component's least `first` (by default the first
    column of keep) is found from the classes' least ones.
    """
    first = F.col(keep[0]) if first is None else first
    rows = stored(fingerprints(docs, keep, text, shingle), "simhash-rows")
    classes = stored(rows.groupBy("fp").agg(F.min(first).alias("least")), "simhash-classes")
    roots = stored(connected_components(links(classes, budget)), "simhash-roots").withColumnRenamed("v", "fp")
    linked = stored(classes.join(roots, "fp").groupBy("root").agg(F.min("least").alias("first")), "simhash-groups")
    named = roots.join(linked, "root")
    named = stored(classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("first")).alias("first")), "simhash-names")
    return rows.join(named, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))
