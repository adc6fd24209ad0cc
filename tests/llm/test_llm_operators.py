"""The operators against brute force on small tables, odd rows included."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, components, linededup, lm, media, mixing, neardup, quality, sharding, simhash, warc

GAPS = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(GAPS, text or "")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.zipf(1.4, n) % 500)


@pytest.fixture(scope="module")
def rows():
    line = prose(7, 60)
    return [
        (1, "the cat sat on the mat " * 30, "en", "a", 1),
        (2, prose(1, 300), "en", "a", 2),
        (3, prose(1, 300), "en", "a", 3),
        (4, prose(1, 300).replace("w1 ", "w2 ", 1), "de", "b", 4),
        (5, None, "en", None, 5),
        (6, "", None, "b", 6),
        (7, "one", "en", "b", 7),
        (7, "one", "en", "b", 7),
        (None, "no id here", "fr", "c", None),
        (8, prose(2, 20_000), "fr", "c", 8),
        (9, "Ünï \U0001f600 <|endoftext|> \x00 a\tb\x0bc\r\n\n  d\x85e", "es", "\U0001f600", 9),
        (10, f"{prose(3, 30)}\n{line}\n\n{prose(4, 40)}", "en", "a", 10),
        (11, f"{prose(5, 35)}\n{line}\n\n{prose(4, 40)}\n{prose(6, 10)}", "en", "a", 11),
        (12, "$%&# " * 200, "en", "a", 12),
    ]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
EXTRA = ["_did", "_th", "_row", "h", "fp", "copies", "kept", "cuts", "component", "shard", "n_tokens", "k", "g", "size", "_n", "raw"]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df, rows):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert {i: len(x) for i, x in out.items()} == dict(Counter(i for i, *_ in rows))
    return out


# ---- BPE ----


def test_bpe_equals_library(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    got = by_id(bpe.encode_decode(docs, bpe.vocabulary()), rows)
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        for r in got[i]:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == (text or "")


def test_bpe_random_texts():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(5)
    pool = [*range(32, 127), 9, 10, 13, 28, 133, 160, 233, 0x3000, 0x4E00, 0x1F600, 0x301]
    texts = ["".join(map(chr, rng.choice(pool, rng.integers(0, 60)))) for _ in range(500)] + ["a" * n for n in range(40)] + ["ab" * 3000, "z" * 5001]
    codec, library = bpe.Codec(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


# ---- media ----


def slow_feature(payload):
    """Mean, entropy and the map of bright bands, sample by sample; the image is 64 wide."""
    mean = sum(payload) / len(payload)
    entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in Counter(payload).values())
    height = len(payload) // 64
    cuts = [int(i * height / 8) for i in range(9)]
    bits = ""
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for x in range(8):
            band = [payload[64 * y + 8 * x + k] for y in range(a, b) for k in range(8)]
            bits += "1" if band and sum(band) / len(band) > mean else "0"
    return f"mean={mean:.4f};entropy={entropy + 0.0:.4f};map={int(bits, 2):016x}"


def test_media_columns(docs, rows):
    import tarfile

    from tidemark.llm.common import row_key, fresh

    folder = fresh(docs.sparkSession, "media-test")
    got = by_id(media.media_columns(docs, folder), rows)
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        for r in got[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["height"] * r["width"]) == (len(data), len(payload), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
            assert r["tail_crc32"] == zlib.crc32(payload[-64:])
            assert r["feature"].replace("=-0.0000", "=0.0000") == slow_feature(payload).replace("=-0.0000", "=0.0000")
            with tarfile.open(folder.removeprefix("file://") + "/" + r["shard"]) as tar:
                member = tar.getmember(f"{r['payload_sha256']}.png")
                assert (member.offset_data, member.size) == (r["offset"], r["length"])
                stored = tar.extractfile(member).read()
            assert hashlib.sha256(stored).hexdigest() == r["media_sha256"] and media.pixels(stored) == payload
    assert got[2][0]["feature"] == got[3][0]["feature"] and got[2][0]["offset"] == got[3][0]["offset"]


# ---- language model ----


def test_lm_scores(docs, rows):
    got = by_id(lm.scores(docs), rows)
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t, *_ in rows}
    fold = {i: zlib.crc32(str(i if i is not None else "").encode()) % 5 for i in tokens}
    counts = Counter(w for i, t, *_ in rows if fold[i] != 1 for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, found in got.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        for r in found:
            assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (fold[i] == 1, len(tokens[i]), n)
            assert r["n_known"] == sum(counts[w] > 0 for w in tokens[i])
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def slow_model(rows, weights):
    """log10 of the model's probability of the word w after the word v, from exact counts; the texts' tokens by id."""
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t, *_ in rows}
    learn = [x for i, x in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(w for x in learn for w in x), Counter(p for x in learn for p in zip([None, *x], x, strict=False))
    n, v = sum(one.values()), len(one)

    def log(a, w):
        l2, l1, l0 = weights[int(math.log2(one[a])) + 1 if one[a] else 0]
        return math.log10(l2 * two[(a, w)] / max(one[a], 1) + l1 * one[w] / n + l0 / (v + 1))

    return log, tokens, one


def learned_weights(monkeypatch, make):
    """The weights that a run learns, and its result."""
    kept, real = [], lm.learned
    monkeypatch.setattr(lm, "learned", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    return make(), kept[0]


def test_lm_scores_equal_exact_counts(spark, monkeypatch):
    """All scores, given the weights; the weights, by exact expectation maximisation; the distribution after a word."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got, weights = learned_weights(monkeypatch, lambda: {r["doc_id"]: r["score"] for r in lm.scores(df).collect()})
    log, tokens, one = slow_model(rows, weights)
    for i, x in tokens.items():
        assert got[i] == pytest.approx(sum(log(a, w) for a, w in zip([None, *x], x, strict=False)), rel=1e-9)
    for a in [None, *(w for w, _ in one.most_common(3)), "a word that no text has"]:
        assert sum(10 ** log(a, w) for w in [*one, "another one"]) == pytest.approx(1, abs=1e-9)
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in tokens}
    base, tune = ([x for i, x in tokens.items() if fold[i] in f] for f in ((2, 3, 4), (0,)))
    c1, c2 = Counter(w for x in base for w in x), Counter(p for x in base for p in zip([None, *x], x, strict=False))
    n, v = sum(c1.values()), len(c1)
    seen = [(int(math.log2(c1[a])) + 1 if c1[a] else 0, c2[(a, w)] / max(c1[a], 1), c1[w] / n, 1 / (v + 1)) for x in tune for a, w in zip([None, *x], x, strict=False)]
    bucket, f = np.array([s[0] for s in seen]), np.array([s[1:] for s in seen])
    exact = np.tile([0.4, 0.4, 0.2], (65, 1))
    for _ in range(lm.ROUNDS):
        share = exact[bucket] * f
        share /= share.sum(axis=1, keepdims=True)
        exact = np.stack([np.bincount(bucket, s, 65) for s in share.T], axis=1) + 1
        exact /= exact.sum(axis=1, keepdims=True)
    assert abs(exact - weights)[1:].max() < 0.02


def test_lm_routes_agree(spark):
    """Counts that go through sums of chunks are those of one exchange."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    one, two = ({r["doc_id"]: r for r in lm.scores(df, *how).collect()} for how in ((1 << 30, 8), (20_000, 3)))
    assert all(two[i]["n_known"] == r["n_known"] and two[i]["train_tokens"] == r["train_tokens"] and two[i]["score"] == pytest.approx(r["score"], rel=1e-9) and two[i]["base_score"] == pytest.approx(r["base_score"]) for i, r in one.items())


@pytest.mark.parametrize("buckets", [2, 6])
def test_lm_counts_beyond_32_bits(spark, buckets):
    codes, counts = np.array([5, 1 << 61, 3 << 62], np.uint64), np.array([(1 << 32) + 5, 7, (1 << 33) + 1], np.uint64)
    rows = [("t", 0, 0, -1, None, None), ("t", 1, 1, -1, None, None)]
    rows += [("u", tune, tune, b, lm.packed(codes[p]), lm.planes(counts[p])) for tune in (0, 1) for b, p in lm.pieces(codes, 64, 2)]
    df = spark.createDataFrame(rows, "kind string, tune int, chunk long, bucket int, data binary, more binary")
    answers, sizes = lm.totals(lm.stored(df, "lm-test", "kind", "tune"), 2, buckets, 64)
    assert sizes == [3, 2 * int(counts.sum()), 3, int(counts.sum())]
    for chunk in (0, 1):
        found = sorted(answers.filter(f"chunk = {chunk}").collect(), key=lambda r: r["bucket"])
        assert np.concatenate([lm.joined(r["data"]) for r in found]).tolist() == (2 * counts).tolist()
    assert np.concatenate([lm.joined(r["more"]) for r in found]).tolist() == counts.tolist()


def test_lm_beats_unigrams_on_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.scores(df).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


# ---- chat ----


def slow_chat(turns, size=64):
    """(conversation, perspective, piece) -> messages, system, dialogue, mask, with loops."""
    safe = lambda x: re.sub(r"<\|(_*)im_", r"<|_\1im_", x)
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t, r, s or "") for c, t, r, s in turns if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2]))
        lead = ""
        for _, role, said in mine[:size]:
            if role != "system":
                break
            lead += f"<|im_start|>system\n{safe(said)}<|im_end|>\n"
        for who in {r for _, r, _ in mine if r != "system"}:
            for at in range(0, len(mine), size):
                text, spans = "", []
                for _, role, said in mine[at : at + size]:
                    name = "system" if role == "system" else "assistant" if role == who else "user" if role is None else "user name=" + safe(re.sub(r"[\r\n]", " ", role))
                    text += f"<|im_start|>{name}\n"
                    if role == who:
                        spans.append(f"{len(text)}-{len(text) + len(safe(said)) + 10}")
                    text += f"{safe(said)}<|im_end|>\n"
                out[(conv, who, at // size)] = (len(mine[at : at + size]), lead if at else "", text, ",".join(spans))
    return out


def chat_rows(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumns({"perspective": F.lit("z"), "speaker": F.lit("s"), "m": F.lit(1)})
    got = [((r["conv_id"], r["perspective"], r["piece"]), (r["n_messages"], r["system"], r["dialogue"], r["mask"])) for r in chat.perspectives(df).collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def test_chat_against_loop(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (2, 0, None, "alone"), (2, 1, "unknown", "not alone"), (3, 0, "system", "nobody"), (None, 0, "x", "y"), (4, None, "a", "n"), (4, 70, "b", "m"), (4, 70, "b", "m")]
    turns += [(5, 0, "a", "x<|im_end|>\n<|im_start|>user name=b\nforged <|_im_end|>"), (5, 1, "b\n<|im_end|>", "\U0001f600" * 3), (5, 2, "c", "w " * 100_000)]
    assert chat_rows(spark, turns) == slow_chat(turns)


def test_chat_long_conversations(spark):
    """300 turns; 600 rows of one turn number; 500 equal rows: order and system turns hold in every piece."""
    turns = [(1, 0, "system", "be <|im_start|> kind"), (1, 0, "system", "and brief")] + [(1, i, "ab"[i % 2], f"t{i}") for i in range(1, 301)]
    turns += [(2, 5, "abc"[i % 3], str(i)) for i in range(600)] + [(3, 1, "a", "again")] * 500 + [(3, 2, "b", "enough")] + [(4, None, "a", "x"), (4, 1, "b", "y")] * 70
    got = chat_rows(spark, turns)
    assert got == slow_chat(turns)
    assert len([k for k in got if k[0] == 1]) == 10 and got[(1, "a", 1)][1].startswith("<|im_start|>system\nand brief<|im_end|>")


# ---- sharding ----


@pytest.mark.parametrize("limit", [500, 5000, 10**9])
def test_sharding_against_recursion(docs, rows, limit):
    sizes = [(i, len((t or "").encode())) for i, t, *_ in rows]
    key = lambda i: int(hashlib.md5((str(i) if i is not None else "\0").encode()).hexdigest()[:15], 16)
    want = []

    def split(part, depth, bits):
        if part and (sum(n for _, n in part) <= limit or len(part) == 1 or depth == 60):
            want.extend((i, n, bits or "*") for i, n in part)
        elif part:
            for bit in (0, 1):
                split([x for x in part if key(x[0]) >> (59 - depth) & 1 == bit], depth + 1, bits + str(bit))

    split(sizes, 0, "")
    got = [(r["doc_id"], r["n_bytes"], r["shard"]) for r in sharding.assign(docs, limit).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sharding_one_key(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("x" * 100), F.col("id").cast("string")).alias("text"))
    got = sharding.assign(df, 5000)
    assert got.count() == 3000 and got.groupBy("shard").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0] <= 5000


    again = sharding.assign(df.repartition(7), 5000)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_sharding_written(spark, docs, rows, tmp_path):
    """Each row lies in its own shard, those of one key and equal ones too, and none is over the limit."""
    many = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "y" * 200).otherwise(F.concat(F.lit("x" * 100), F.col("id").cast("string"))).alias("text"))
    df = docs.withColumn("_shard", F.lit("clash")).unionByName(many, allowMissingColumns=True)
    found = sharding.write_shards(df, f"file://{tmp_path}/s", 5000)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.columns == [*df.columns, "__shard"] and back.count() == len(rows) + 300
    sizes = {r["__shard"]: (r["b"], r["n"]) for r in back.groupBy("__shard").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {r["shard"]: (r["shard_bytes"], r["shard_rows"]) for r in found.select("shard", "shard_bytes", "shard_rows").distinct().collect()}
    assert all(b <= 5000 or n == 1 for b, n in sizes.values())


# ---- mixing ----


def test_mixing(spark, docs, rows):
    many = [(100 + i, prose(i, 20 + i % 50), "en", f"s{i % 5}", 0) for i in range(400)]
    df = docs.unionByName(spark.createDataFrame(many, COLUMNS), allowMissingColumns=True)
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(3)).toPandas()
    assert sorted(map(str, got[["doc_id", "size", "taken"]].values.tolist())) == sorted(map(str, again[["doc_id", "size", "taken"]].values.tolist()))
    size = {}
    for _, text, _, source, _ in [*rows, *many]:
        size[source] = size.get(source, 0) + len(words(text))
    order = [*sorted((s for s in size if s is not None), key=lambda s: s.encode()), *([None] if None in size else [])]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        left, w = total - sum(2 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / w for s in order}
        if not (more := {s for s in order if target[s] > 2 * size[s] and s not in full}):
            break
        full |= more
    for source in order:
        mine = got[got.source.isna()] if source is None else got[got.source == source]
        assert mine.target.iloc[0] == pytest.approx(target[source]) and mine.source_size.iloc[0] == size[source]
        assert abs(mine.taken.sum() - target[source]) <= max(1, mine["size"].max() / 2)
        assert abs((mine.rate * mine["size"]).sum() - target[source]) <= 1e-6 * max(1, target[source])
        tilt = (np.log(mine.rate) / mine["size"])[(mine.rate > 0) & (mine.rate < 2) & (mine["size"] > 0)]
        assert len(tilt) == 0 or np.ptp(tilt) < 1e-9
    assert (abs(got.copies - got.rate) < 2).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == got.copies.sum()


def test_mixing_repeated_rows(spark):
    """One row a thousand times, and rows that agree but for a column that the mix doesn't read."""
    rows = [(1, prose(1, 10), "en", "a", 0)] * 1000 + [(2, prose(2, 10), "en", "b", i) for i in range(999)] + [(3, "", "en", "b", 0)] * 3 + [(10 + i, prose(i, 7), "en", "c", i) for i in range(50)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    for _, mine in got.groupby("source"):
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= 5
    out = mixing.mixed(df)
    assert out.count() == got.copies.sum() and out.filter("doc_id = 2").groupBy("n_chars").count().agg(F.max("count")).first()[0] <= 2
    assert sorted(map(str, mixing.mix(df.repartition(5)).collect())) == sorted(map(str, mixing.mix(df).collect()))


# ---- SimHash ----


def slow_fingerprint(text, shingle=3):
    import xxhash

    found = words((text or "").translate(LOWER))
    if not found:
        return 0
    parts = [" ".join(found[i : i + shingle]) for i in range(len(found) - shingle + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(docs, rows):
    got = by_id(simhash.fingerprints(docs), rows)
    for i, text, *_ in rows:
        assert all(r["fp"] & (2**64 - 1) == slow_fingerprint(text) for r in got[i])


@pytest.mark.parametrize(("budget", "dense"), [(3, False), (3, True), (6, False), (0, True)])
def test_trie_links(budget, dense):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    codes = np.concatenate([base, *(base[: (3 if dense else 40)] ^ (np.uint64(1) << rng.integers(0, 64, (3 if dense else 40)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (3 if dense else 40)).astype(np.uint64)) for _ in range(80 if dense else 5))])
    codes = np.unique(codes)
    labels = simhash.trie_links(codes, 0, budget)
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if int(codes[i] ^ codes[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert labels.tolist() == [root(i) for i in range(len(codes))]


@pytest.mark.parametrize("budget", [3, 8])
def test_simhash_components(spark, budget):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = simhash.near_duplicates(df, budget=budget).toPandas()
    plain = lambda f: int(f) & (2**64 - 1)
    fps = sorted({plain(f) for f in got.fp})
    group = {f: {f} for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= budget and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    name = {f: i for i, g in enumerate({id(g): g for g in group.values()}.values()) for f in g}
    pairs = set(zip(got.component, (name[plain(f)] for f in got.fp), strict=True))
    assert len(pairs) == got.component.nunique() == len(set(name.values()))
    assert (got.groupby("component").doc_id.transform("min") == got["first"]).all()


# ---- near-dedup by similarity ----


def shingle_set(text, shingle=5):
    found = words((text or "").translate(LOWER))
    return frozenset(tuple(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1)))


def near(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def slow_groups(rows):
    """The least (id, ...) of each component of texts with similar shingle sets, by comparing all."""
    sets = sorted({(i is None, i or 0, shingle_set(t)) for i, t, *_ in rows}, key=lambda x: x[:2])
    left, first = list(range(len(sets))), []
    while left:
        todo, left = [left[0]], left[1:]
        first.append(todo[0])
        while todo:
            x = todo.pop()
            found = [y for y in left if near(sets[x][2], sets[y][2])]
            left = [y for y in left if y not in found]
            todo += found
    return sorted((sets[x][0], sets[x][1]) for x in first)


def edited(seed, base, changes):
    """base with every `changes`-th word another one, from a random place on."""
    rng = np.random.default_rng(seed)
    out = base.split()
    for at in range(int(rng.integers(0, changes)), len(out), changes):
        out[at] = f"new{rng.integers(0, 10**9)}"
    return " ".join(out)


def test_neardup_odd_rows(docs, rows):
    got = neardup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == slow_groups(rows)


def test_neardup_groups(spark):
    """A hub with copies that are not similar to each other, chains, copies in other letter case, unlike texts with a common passage."""
    rows, passage = [], prose(77, 150)
    for k in range(6):
        base = prose(1000 + k, 400)
        rows += [(100 * k + j + 5, edited(50 * k + j, base, 45 + j), "en", "a", 0) for j in range(8)] + [(100 * k + 50, base, "en", "a", 0), (100 * k + 51, base.upper(), "en", "a", 0)]
        chain = base = prose(2000 + k, 300)
        for j in range(5):
            chain = edited(10_000 + 50 * k + j, chain, 60)
            rows.append((100 * k + 60 + j, chain, "de", "a", 0))
    rows += [(5000 + i, f"{prose(3000 + i, 60)} {passage}", "en", "b", 0) for i in range(60)]
    got = neardup.deduplicated(spark.createDataFrame(rows, COLUMNS).repartition(5))
    assert sorted((False, r["doc_id"]) for r in got.collect()) == slow_groups(rows)


def test_neardup_repeated_shingles(spark):
    """Repeats move a fingerprint, but not a set of shingles."""
    base = prose(77, 200)
    rows = [(1, base, "en", "a", 0), (2, base + " one two three four five" * 300, "en", "a", 0)]
    assert [r["doc_id"] for r in neardup.deduplicated(spark.createDataFrame(rows, COLUMNS)).collect()] == [1]


def test_neardup_large_bucket_is_settled_whole(spark, monkeypatch):
    """Chains in which only neighbours are similar, all in one bucket: far more groups than hubs, cells and turns."""
    monkeypatch.setattr(neardup, "CELL", 16)
    rows = []
    for k in range(5):
        line = prose(4000 + k, 900).split()
        rows += [(100 * k + i, " ".join(line[18 * i : 18 * i + 200]), "en", "a", 0) for i in range(35)]
    docs = neardup.row_key(spark.createDataFrame([(i, t, a, b, n) for i, t, a, b, n in rows if i % 100 != 17], COLUMNS))
    classes = neardup.signatures(docs, ("_did", "_th")).withColumns({"least": F.struct("_did", "_th"), "bands": F.array(F.lit(7).cast("long"))}).drop("_did", "_th")
    ids = {r["id"]: r["least"]["_did"] for r in classes.collect()}
    got = components.connected_components(neardup.near_links(classes, docs)).groupBy("root").agg(F.collect_list("v").alias("v")).collect()
    want = [[100 * k + i for i in part] for k in range(5) for part in (range(17), range(18, 35))]
    assert sorted(sorted(ids[bytes(v)] for v in r["v"]) for r in got) == want


def test_neardup_recall_at_the_border(spark):
    rows, pairs, k = [], 0, 0
    while pairs < 300:
        k += 1
        base = prose(20_000 + k, 200)
        copy = edited(k, base, 50 + k % 20)
        a, b = shingle_set(base), shingle_set(copy)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * pairs, base, "en", "a", 0), (2 * pairs + 1, copy, "en", "a", 0)]
            pairs += 1
    got = neardup.deduplicated(spark.createDataFrame(rows, COLUMNS)).collect()
    assert all(r["doc_id"] % 2 == 0 or r["doc_id"] - 1 in {x["doc_id"] for x in got} for r in got) and len(got) <= 300 + 30


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["v"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        todo = [v] if v not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = v
                todo += near[x]
    assert got == want


# ---- quality ----


def slow_statistics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_statistics(docs, rows):
    got = by_id(quality.verdicts(docs), rows)
    for i, text, *_ in rows:
        want = slow_statistics(text)
        for r in got[i]:
            assert tuple(r[c] for c in NAMES) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    want = slow_verdicts([(r["doc_id"], r["lang"], r["source"], tuple(r[c] for c in NAMES)) for found in got.values() for r in found])
    assert all(r["kept"] == want[r["doc_id"]] for found in got.values() for r in found)


def logdet(cov):
    return np.linalg.slogdet(cov)[1]


def slow_fits(groups):
    """Of each group the best of three starts' concentrated means, covariance and number of documents; exact sums."""
    ridge = np.diag(np.square(quality.RIDGE))
    median = lambda c: np.sort(np.floor(c * quality.UNIT + 0.5))[(len(c) - 1) // 2] / quality.UNIT
    scale = quality.SHARE / quality.chi2_cdf(quality.chi2_cut(1 - quality.SHARE, 5), 7)
    state = {}
    for g, x in groups.items():
        mid = np.array([median(c) for c in x.T])
        dev = np.array([median(np.abs(c - m)) for c, m in zip(x.T, mid, strict=True)])
        for start, (m, cov) in enumerate([(mid, np.diag((1.4826 * dev) ** 2)), (mid, np.zeros((5, 5))), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(5, 5))]):
            least = math.inf
            while True:
                cell = np.floor(np.log2(slow_distances(x, m, cov) + 1e-6) * quality.GRID)
                cells, n = np.unique(cell, return_counts=True)
                inner = x[np.isin(cell, cells[np.cumsum(n) - n < quality.SHARE * len(x)])]
                new = np.cov(inner.T, bias=True).reshape(5, 5) * scale
                if not least - logdet(new + ridge) > quality.SETTLED:
                    break
                m, cov, least = inner.mean(axis=0), new, logdet(new + ridge)
                state[(g, start)] = (m, cov, len(inner))
    best = {g: min((logdet(state[(g, s)][1] + ridge), s) for s in range(3))[1] for g in groups}
    return {g: state[(g, s)] for g, s in best.items()}


def slow_distances(x, mid, cov):
    return np.einsum("ij,jk,ik->i", x - mid, np.linalg.inv(cov + np.diag(np.square(quality.RIDGE))), x - mid)


def slow_shrunk(fits):
    out = {}
    for g in sorted(fits, key=len):
        mid, cov, n = fits[g]
        w = n / (n + quality.PRIOR)
        above, spread = out[g[:-1]] if g else (mid, np.diag(np.square(quality.SPREAD)))
        out[g] = (above + w * (mid - above), w * cov + (1 - w) * spread + w * (1 - w) * np.outer(mid - above, mid - above))
    return out


def slow_vector(stats):
    n = max(stats[0], 1)
    return [math.log(max(stats[1], 1) / n), math.log1p(1000 * stats[2] / n), math.log1p(1000 * stats[3] / n), math.log1p(100 * stats[4] / n), math.log(n)]


def slow_verdicts(rows):
    """id -> kept, of rows (id, language, source, statistics)."""
    bad = lambda s: s[0] < 50 or 100 * s[4] > 50 * s[0]
    ok = [(i, (lang, source), slow_vector(s)) for i, lang, source, s in rows if not bad(s)]
    groups = {}
    for _, g, x in ok:
        for k in ((), g[:1], g):
            groups.setdefault(k, []).append(x)
    groups = {g: np.array(x) for g, x in groups.items()}
    first, inside = slow_shrunk(slow_fits(groups)), quality.chi2_cut(0.025, 5)
    again = {}
    for g, x in groups.items():
        inner = x[slow_distances(x, *first[g]) <= inside]
        again[g] = (inner.mean(axis=0), np.cov(inner.T, bias=True).reshape(5, 5) * 0.975 / quality.chi2_cdf(inside, 7), len(inner)) if len(inner) else (*first[g], 0)
    last = slow_shrunk(again)
    return {i: False for i, _, _, s in rows if bad(s)} | {i: slow_distances(np.array([x]), *last[g])[0] <= quality.chi2_cut(quality.TAIL, 5) for i, g, x in ok}


def test_quality_outliers(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = slow_verdicts([(r["doc_id"], r["lang"], r["source"], slow_statistics(r["text"])) for r in df.collect()])
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(df).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_quality_judges_small_groups(spark):
    """No group is too small: junk goes from a small source of a large language and from a small language."""
    text = lambda i: "\n".join(f"{prose(31 * i + k, 30)} u{i}x{k}" for k in range(8 + i % 5))
    junk = lambda i: " ".join(f"#$%& {'q' * 30}{i}x{k} *|<>" for k in range(80))
    rows = [(i, text(i), "en", "large", 0) for i in range(300)]
    rows += [(1000 + i, junk(i) if i < 5 else text(1000 + i), "en", "small", 0) for i in range(40)]
    rows += [(2000 + i, junk(100 + i) if i < 3 else text(2000 + i), None, "small", 0) for i in range(20)] + [(3000, junk(300), "fr", None, 0), (3001, text(3001), "de", None, 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(df).collect()}
    assert got == slow_verdicts([(i, lang, source, slow_statistics(t)) for i, t, lang, source, _ in rows])
    assert [i for i, kept in got.items() if i >= 1000 and not kept] == [i for i in got if 1000 <= i < 1005 or 2000 <= i < 2003 or i == 3000]


def test_quality_filter_tells_sources_apart(spark):
    """Rows that agree in id and text but not in source are judged by their own source."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    twin = df.unionByName(df.withColumn("source", F.lit("other")).withColumn("lang", F.lit(None).cast("string")))
    want = {(r["doc_id"], r["source"]) for r in quality.verdicts(twin).filter("kept").collect()}
    assert {(r["doc_id"], r["source"]) for r in quality.filtered(twin).collect()} == want


@pytest.mark.parametrize("sf", ["sf0.1", "sf0.01"])
def test_quality_keeps_good_documents(spark, sf):
    """RIDGE and TAIL were chosen on sf0.1; the documents of sf0.01 had no part in that."""
    d = f"/root/testdata/{sf}"
    df = quality.verdicts(spark.read.parquet(f"{d}/documents.parquet")).filter("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    got = {r["quality"]: r["k"] for r in df.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert got[1] > 0.995 and got[0] < 0.01


def test_chi2():
    assert quality.chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5) and quality.chi2_cut(0.025, 5) == pytest.approx(12.8325, abs=1e-3)


# ---- line dedup ----


def slow_line_dedup(rows, window=50):
    """All runs of lines of 50 words or more, over distinct (id, text): those that occurred before go."""
    texts = sorted({(i, t) for i, t, *_ in rows if t})
    first, gone = {}, {key: set() for key in texts}
    for key in texts:
        real = [(p, x, len(words(x))) for p, x in enumerate(key[1].split("\n")) if words(x)]
        for a in range(len(real)):
            n = 0
            for b in range(a, len(real)):
                n += real[b][2]
                if n >= window:
                    old, end = first.setdefault(tuple(x for _, x, _ in real[a : b + 1]), (key, b))
                    if old != key or a > end:
                        gone[key] |= set(range(real[a][0], real[b][0] + 1))
    return {key: "\n".join(x for p, x in enumerate(key[1].split("\n")) if p not in gone[key]) for key in texts}


def test_line_dedup_against_loop(docs, rows):
    want = slow_line_dedup([r for r in rows if r[0] is not None])
    for r in linededup.line_dedup(docs).collect():
        given = next(t for i, t, *_ in rows if i == r["doc_id"])
        assert r["text"] == (want.get((r["doc_id"], given), given) if given else given)
    cut = {r["doc_id"]: r for r in linededup.line_dedup(docs).collect()}
    assert cut[10]["n_removed"] == 0 and cut[11]["n_removed"] == 3 and cut[3]["text"] == "" and cut[2]["text"]


def test_line_dedup_random(spark):
    rng = np.random.default_rng(11)
    pool = [prose(int(s), int(n)) for s, n in zip(rng.integers(0, 9999, 30), rng.integers(1, 40, 30), strict=True)] + ["", " "]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, 32, rng.integers(1, 25))), "", "", 0) for i in range(60)]
    want = slow_line_dedup(rows)
    got = {(r["doc_id"]): r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: want[(i, t)] if t else t for i, t, *_ in rows}


def test_line_dedup_beyond_first_occurrence(spark):
    """A run whose middle occurs still earlier elsewhere, and texts that repeat themselves."""
    rows = []
    for k in range(12):
        middle = "\n".join(prose(900 + 20 * k + j, 12) for j in range(5))
        run = f"{prose(300 + k, 5)}\n{middle}\n{prose(400 + k, 5)}"
        rows += [(10 * k, f"{prose(500 + k, 9)}\n{middle}\n{prose(600 + k, 9)}", "", "", 0), (10 * k + 1, f"{prose(700 + k, 9)}\n{run}", "", "", 0), (10 * k + 2, f"{run}\n{prose(800 + k, 9)}", "", "", 0)]
    rows += [(1000, "\n".join([prose(1, 12)] * 40), "", "", 0), (1001, "\n".join(f"{prose(2, 10)}\n\n{prose(3, 45)}" for _ in range(9)), "", "", 0)]
    want = slow_line_dedup(rows)
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: want[(i, t)] for i, t, *_ in rows}
    assert all(got[10 * k + 2] == prose(800 + k, 9) for k in range(12)) and got[1000] == "\n".join([prose(1, 12)] * 5)


def test_line_dedup_guarantee(spark):
    """A shared run of 50 words or more, cut into lines of any lengths, goes from the later text."""
    shared = "\n".join(prose(100 + k, 7) for k in range(9))
    rows = [(i, f"{prose(i, 40)}\n{shared}\n{prose(50 + i, 40)}", "", "", 0) for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert shared in got[0] and all(got[i] == f"{prose(i, 40)}\n{prose(50 + i, 40)}" for i in range(1, 20))


# ---- WARC ----


def test_warc_round_trip(spark):
    big = "x" * 1500
    pages = [(1, "http://a/", big), (2, "http://b/", big), (3, None, "small"), (4, "http://c/\r\nx", "small"), (5, "http://d/", None), (None, "http://e/", big), (6, "http://f/", "é" * 700), (2, "http://b/", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    captures = warc.round_trip(df)
    assert captures.count() == len(pages)
    for r in captures.collect():
        assert r["request"]["method"] == "GET" and r["metadata"]["fields"]["fetchTimeMs"] == "0"
    kinds = sorted((str(r["metadata"]["fields"].get("page_id")), r["response"]["type"]) for r in captures.collect())
    assert kinds == sorted([("1", "revisit"), ("2", "response"), ("2", "response"), ("3", "response"), ("4", "response"), ("5", "response"), ("6", "response"), ("None", "revisit")])


def test_warc_members_in_pieces():
    import io

    data = b"".join(warc.record("response", f"0000-{i}", "http://a/", "text/plain", b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * i, []) for i in range(300))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    got = [warc.parsed(m) for m in warc.members(Slow(data))]
    assert [r["payload_bytes"] for r in got] == list(range(300))
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(io.BytesIO(data[:-5])))


# ---- all ----


def test_empty_tables(spark, none):
    assert bpe.encode_decode(none, bpe.vocabulary()).count() == 0
    assert media.media_columns(none).count() == 0
    assert lm.scores(none).count() == 0
    assert sharding.assign(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and neardup.deduplicated(none).count() == 0
    assert quality.verdicts(none).count() == 0 and quality.filtered(none).count() == 0
    assert linededup.line_dedup(none).count() == 0
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
