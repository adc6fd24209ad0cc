"""Language-model scoring: deleted interpolation of word n-grams.

P(w | v) = l2 f(w | v) + l1 f(w) + l0 / (V + 1), where the f are relative
frequencies in the training documents and the weights l belong to the bucket
of the frequency of the context v. The weights are learned by expectation
maximisation on counts of documents held out of the frequencies for that; the
frequencies used for scoring are those of all training documents.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import removed, ship, stored, table

ship(__name__)

#: Folds of crc32(doc_id): TEST is never learned from, TUNE teaches the weights first.
FOLDS, TEST, TUNE = 5, 1, 0
#: Tokens after which a task closes a chunk, and bytes of text for each bucket of counts.
CHUNK_TOKENS, BUCKET_BYTES = 2_000_000, 8 << 20
#: Ranges of hashes that a chunk's counts are cut into at most.
FAN = 1024
#: Bits of a pair's hash beyond those of the corpus size: one pair in a million shares its hash.
SPARE_BITS = 20
#: Frequencies are told apart in quarters of an octave when the weights are learned.
GRID = 4
ROUNDS = 60
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def packed(codes: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane."""
    steps = np.diff(codes, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(rows_of(data, 8), dtype=np.uint64)


def planes(numbers: np.ndarray) -> bytes:
    """Their width, 4 or 8 bytes as the greatest needs, and the numbers byte plane by byte plane, which packs better."""
    width = 8 if len(numbers) and int(numbers.max()) >> 32 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def joined(data: bytes) -> np.ndarray:
    return rows_of(data[1:], data[0])


def rows_of(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def pieces(codes: np.ndarray, bits: int, buckets: int, first: int = 0, last: int | None = None):
    """(bucket, slice) of sorted codes of so many bits: those of each bucket from first to last that has any."""
    where = ((codes >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    last = buckets if last is None else last
    cuts = np.searchsorted(where, np.arange(first, last + 1, dtype=np.uint64)).tolist()
    return [(first + i, slice(s, e)) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if s < e]


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of word hashes."""
    x = v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs(tokens: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (previous token, token) pairs, each token's pair, and the pairs' hashes.

    Every text ends with the end token, which is also what precedes the first.
    """
    keys = np.concatenate([tokens[-1:], tokens[:-1]]).astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    kinds = keys[new]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    codes = mixed(hashes[kinds >> np.uint64(32)], hashes[kinds & np.uint64(0xFFFFFFFF)]) >> np.uint64(64 - bits)
    return kinds, at, codes


def chunks(docs: DataFrame, ranges: int, bits: int) -> DataFrame:
    """Token arrays of documents, and per chunk its distinct words and pairs with counts.

    kind t: a chunk's documents (ids, folds, sizes, data: tokens as indexes
    into more: word hashes). kinds u, b: for one range of hashes (bucket, one of
    `ranges`) the
    chunk's sorted words or pairs (data) and how often its training documents
    have them (more). Chunks of the TUNE fold are apart (tune).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        ids = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))
        open_: dict[int, list] = {}
        sizes_ = {0: 0, 1: 0}

        def rows(tune: int):
            vocab, docs_, tokens = open_.pop(tune)
            chunk = next(ids)
            flat = np.concatenate(tokens)
            often = np.argsort(-np.bincount(flat, minlength=len(vocab)), kind="stable")
            place = np.empty(len(often), np.uint32)
            place[often] = np.arange(len(often), dtype=np.uint32)
            flat = place[flat]
            words = list(vocab)
            hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), ">u8").astype(np.uint64)[often]
            sizes = np.array([n for *_, n in docs_], np.int64)
            learn = np.repeat(np.array([f != TEST for _, f, _ in docs_]), sizes)
            yield ("t", tune, chunk, -1, [i for i, *_ in docs_], [f for _, f, _ in docs_], sizes.tolist(), planes(flat), hashes.astype("<u8").tobytes())
            kinds, at, codes = pairs(flat, hashes, bits)
            counts, order = np.bincount(at, learn, minlength=len(kinds)), np.argsort(codes)
            by = np.argsort(hashes)
            for kind, codes, counts, width in (("u", hashes[by], np.bincount(flat, learn, minlength=len(hashes))[by], 64), ("b", codes[order], counts[order], bits)):
                for b, part in pieces(codes, width, ranges):
                    yield (kind, tune, chunk, b, [], [], [], packed(codes[part]), planes(counts[part]))

        def batch(made):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

        for got in batches:
            types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(got.column(0).type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            for i, fold, text in zip(*(got.column(c) for c in range(3)), strict=True):
                fold = fold.as_py()
                tune = int(fold == TUNE)
                if tune not in open_:
                    vocab: dict = defaultdict(counter().__next__)
                    vocab[b""]
                    open_[tune] = [vocab, [], []]
                vocab, docs_, tokens = open_[tune]
                found = list(map(vocab.__getitem__, (text.as_py() or "").encode().translate(LOWER).split()))
                found.append(0)
                tokens.append(np.array(found, np.int32))
                docs_.append((i.as_py(), fold, len(found)))
                sizes_[tune] += len(found)
                if sizes_[tune] >= CHUNK_TOKENS:
                    sizes_[tune] = 0
                    yield batch(list(rows(tune)))
        for tune in list(open_):
            yield batch(list(rows(tune)))

    names = ["kind", "tune", "chunk", "bucket", "ids", "folds", "sizes", "data", "more"]
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")
    made = docs.select("doc_id", fold.alias("fold"), "text").mapInArrow(run, f"kind string, tune int, chunk long, bucket int, ids array<{kind}>, folds array<int>, sizes array<int>, data binary, more binary")
    return stored(made, "lm-chunks", "kind", "tune")


ASKED = "kind string, bucket int, tune int, asker long, data binary, more binary, less binary"
ANSWER = "asker long, kind string, bucket int, tune int, data binary, more binary"


def arrow(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def summed(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct codes of all pieces, in order, with their counts and those without the TUNE fold; each piece's places in them.

    tune 0: a chunk's piece; 1: one of the TUNE fold; 2: pieces summed before, less has the counts without that fold.
    """
    codes = [unpacked(x.as_py()) for x in asked.column("data")]
    more = [joined(x.as_py()) for x in asked.column("more")]
    less = [joined(x.as_py()) if t == 2 else m * np.uint64(t == 0) for x, t, m in zip(asked.column("less"), asked.column("tune").to_pylist(), more, strict=True)]
    kinds, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = lambda c: np.bincount(at, np.concatenate(c), len(kinds)).astype("<u8")
    cuts = np.cumsum([0, *map(len, codes)]).tolist()
    return kinds, total(more), total(less), [at[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def replies(asked: pa.Table, every: np.ndarray, base: np.ndarray, places: list[np.ndarray]) -> list[tuple]:
    """For each piece its codes' counts, as ANSWER."""
    keys = zip(*(asked.column(c).to_pylist() for c in ("asker", "kind", "bucket", "tune")), places, strict=True)
    return [(asker, kind, bucket, t, planes(every[at]), planes(base[at]) if t else b"") for asker, kind, bucket, t, at in keys]


def totals(found: DataFrame, ranges: int, buckets: int, bits: int) -> tuple[DataFrame, list[int]]:
    """Each chunk's words and pairs with their frequencies in all chunks; V, N, and both without the TUNE fold.

    A bucket's owner adds up the counts of all pieces of its range of hashes and
    answers each of them in the order in which it asked: data has the counts in
    all training documents, more those without the TUNE fold. Where there are
    more buckets than ranges, some hundred chunks' pieces of a range are summed
    first, and the sums ask its buckets; so the number of pieces grows with the
    corpus, not with its square.
    """
    spark = found.sparkSession
    asked = found.filter(F.col("kind").isin("u", "b")).select("kind", "bucket", "tune", F.col("chunk").alias("asker"), "data", "more", F.lit(b"").alias("less"))
    per = buckets // ranges

    def own(asked: pa.Table) -> pa.Table:
        _, every, base, places = summed(asked)
        rows = [(*r, None, None, None, None) for r in replies(asked, every, base, places)]
        rows.append((-1, asked.column("kind")[0].as_py(), asked.column("bucket")[0].as_py(), 0, b"", b"", *(int(x) for x in ((every > 0).sum(), every.sum(), (base > 0).sum(), base.sum()))))
        return arrow(rows, ANSWER + ", v long, n long, v0 long, n0 long")

    def ask(pieces_: pa.Table) -> pa.Table:
        kind, range_, group = (pieces_.column(c)[0].as_py() for c in ("kind", "bucket", "group"))
        codes, every, base, _ = summed(pieces_)
        parts = pieces(codes, 64 if kind == "u" else bits, buckets, range_ * per, (range_ + 1) * per)
        return arrow([(kind, b, 2, group, packed(codes[p]), planes(every[p]), planes(base[p])) for b, p in parts], ASKED)

    def tell(key, pieces_: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        every, base = (np.concatenate([joined(x.as_py()) for x in answers.column(c)]) for c in ("data", "more"))
        return arrow(replies(pieces_, every, base, summed(pieces_)[3]), ANSWER)

    if per > 1:
        groups = -(-found.filter("kind = 't'").count() // FAN)
        asked = asked.withColumn("group", F.pmod(F.xxhash64("asker"), F.lit(groups)))
        first, asked = asked, stored(asked.groupBy("kind", "bucket", "group").applyInArrow(ask, ASKED), "lm-sums")
    answers = stored(asked.groupBy("kind", "bucket").applyInArrow(own, ANSWER + ", v long, n long, v0 long, n0 long"), "lm-totals")
    sizes = [x or 0 for x in answers.filter("asker = -1 AND kind = 'u'").agg(*(F.sum(c) for c in ("v", "n", "v0", "n0"))).first()]
    answers = answers.filter("asker >= 0").select("asker", "kind", "bucket", "tune", "data", "more")
    if per > 1:
        back = answers.withColumn("range", F.expr(f"bucket div {per}")).withColumnRenamed("asker", "group")
        both = first.withColumn("range", F.col("bucket").cast("long")).groupBy("kind", "range", "group").cogroup(back.groupBy("kind", "range", "group"))
        answers = stored(both.applyInArrow(tell, ANSWER), "lm-answers")
    for kind in ("u", "b"):  # answered, and as large as all the rest
        removed(spark, f"{found._place}/kind={kind}")
    return answers.withColumnRenamed("asker", "chunk"), sizes


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else its frequency's octave, from 1 on."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


def frequencies(tokens: pa.Table, answers: pa.Table, part: str, n: int, bits: int) -> tuple[np.ndarray, ...]:
    """For one chunk: its tokens, their words' counts, its pairs' f2, f1 and bucket, each token's pair."""
    flat = joined(tokens.column("data")[0].as_py())
    hashes = np.frombuffer(tokens.column("more")[0].as_py(), "<u8")
    answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    got = {k: np.concatenate([joined(x.as_py()) for x, kind in zip(answers.column(part), answers.column("kind").to_pylist(), strict=True) if kind == k]) for k in ("u", "b")}
    words = np.empty(len(hashes), np.int64)
    words[np.argsort(hashes)] = got["u"]
    kinds, at, codes = pairs(flat, hashes, bits)
    both = np.empty(len(kinds), np.int64)
    both[np.argsort(codes)] = got["b"]
    context = words[kinds >> np.uint64(32)]
    f1 = words[kinds & np.uint64(0xFFFFFFFF)] / max(n, 1)
    return flat, words, both / np.maximum(context, 1), f1, context_bucket(context), at


def learned(found: DataFrame, answers: DataFrame, v: int, n: int, bits: int, rounds: int = ROUNDS) -> np.ndarray:
    """The weights l2, l1, l0 of each context bucket.

    The TUNE fold's tokens are counted in cells of (bucket, f2, f1) on a
    logarithmic grid; that table is bounded by the grid, not by the corpus,
    and expectation maximisation runs on it here. One pseudo-count each keeps
    the weights positive.
    """

    def cells(key, tokens: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, f2, f1, bucket, at = frequencies(tokens, answers, "more", n, bits)
        times = np.bincount(at)
        grid = lambda f: np.where(f > 0, np.round(np.log2(np.maximum(f, 1e-300)) * GRID), 1).astype(np.int64)
        cell = (bucket << 32) + ((grid(f2) + 32768) << 16) + grid(f1) + 32768
        kinds, at = np.unique(cell, return_inverse=True)
        return pa.table({"b": kinds >> 32, "q2": (kinds >> 16 & 65535) - 32768, "q1": (kinds & 65535) - 32768, "c": np.bincount(at, times).astype(np.int64)})

    chunk = found.filter("kind = 't' and tune = 1").select("chunk", "data", "more").groupBy("chunk")
    asked = answers.filter("tune = 1").select("chunk", "kind", "bucket", "more").groupBy("chunk")
    rows = chunk.cogroup(asked).applyInArrow(cells, "b long, q2 long, q1 long, c long").groupBy("b", "q2", "q1").agg(F.sum("c").alias("c")).toArrow()
    b, q2, q1, c = (rows.column(x).to_numpy() for x in ("b", "q2", "q1", "c"))
    f = np.stack([np.where(q2 == 1, 0.0, 2.0 ** (q2 / GRID)), np.where(q1 == 1, 0.0, 2.0 ** (q1 / GRID)), np.full(len(c), 1 / (v + 1))])
    weights = np.tile([0.4, 0.4, 0.2], (65, 1))
    for _ in range(rounds):
        share = weights[b].T * f
        share = share / share.sum(axis=0) * c
        sums = np.stack([np.bincount(b, s, minlength=65) for s in share], axis=1) + 1
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # no pair of an unseen context is known
    return weights


def scores(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    One row for each input row; repeated rows count as often as they occur. A
    null text has the end token only; a null doc_id falls into fold 0. held_out
    rows (fold TEST) are scored like the others and never learned from. score
    is the model's and base_score the add-half unigram model's log10
    probability. An empty table gives an empty one. Columns besides doc_id and
    text are not read.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(64, max(size, 1 << 16).bit_length() + SPARE_BITS)
    buckets = max(1, -(-size // bucket_bytes))
    ranges = min(buckets, fan)
    buckets = ranges * -(-buckets // ranges)
    found = chunks(docs.select("doc_id", "text"), ranges, bits)
    answers, (v, n, v0, n0) = totals(found, ranges, buckets, bits)
    weights = learned(found, answers, v0, n0, bits)

    def score(key, tokens: pa.Table, answers: pa.Table) -> pa.Table:
        flat, words, f2, f1, bucket, at = frequencies(tokens, answers, "data", n, bits)
        p = weights[bucket, 0] * f2 + weights[bucket, 1] * f1 + weights[bucket, 2] / (v + 1)
        logs = np.log10(p)[at]
        base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))
        sizes = tokens.column("sizes")[0].values.to_numpy()
        starts = np.cumsum(sizes) - sizes
        folds = tokens.column("folds")[0].values.to_numpy()
        total = lambda x: np.add.reduceat(x, starts)
        return pa.table({"doc_id": tokens.column("ids")[0].values, "held_out": folds == TEST, "n_tokens": sizes.astype(np.int64), "n_known": total((words > 0)[flat].astype(np.int64)), "train_tokens": np.full(len(sizes), n, np.int64), "base_score": total(base[flat]), "score": total(logs)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    chunk = found.filter("kind = 't'").select("chunk", "ids", "folds", "sizes", "data", "more").groupBy("chunk")
    asked = answers.select("chunk", "kind", "bucket", "data").groupBy("chunk")
    return chunk.cogroup(asked).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
