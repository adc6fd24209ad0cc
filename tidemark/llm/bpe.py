"""Byte-level BPE encoding with a pair occurrence index, and decoding."""

from __future__ import annotations

import json
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, table

ship(__name__)

#: The public split pattern of byte-level BPE, with Unicode's own white space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Words whose ids a worker remembers, and characters that it encodes at a time; neither changes results.
REMEMBERED, BATCH_BYTES = 400_000, 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


class Codec:
    """A tokenizer file's vocabulary, with an encoder and a decoder."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level files without normalizer and prefix space are read")
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space or stand alone are not read")
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        self.left, self.right, self.made = left, right, made
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.find = regex.compile(SPLIT).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of neighbours, -1 for none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers.

        All words lie in one array of symbols with a stop (-1) before, between
        and behind them. The index maps each mergeable pair to the positions of
        its left symbols. The lowest active rank is applied to all of its
        positions from left to right; only the lists of the pairs that this
        makes are extended. Stale positions are told by the symbols there.
        """
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"\0" + b"\0".join(raw) + b"\0", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        stops = np.concatenate([[0], ends])
        sym = self.first[flat]
        sym[stops] = -1
        nxt, prv = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(pos: np.ndarray) -> None:
            rank = self.rank(sym[pos], sym[nxt[pos]])
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, chunk in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heappush(active, r)
                index[r].append(chunk)

        note(np.arange(len(sym) - 1))
        while active:
            r = heappop(active)
            pos = index.pop(r)
            pos = np.unique(np.concatenate(pos)) if len(pos) > 1 else np.sort(pos[0])
            a, b = int(self.left[r]), int(self.right[r])
            pos = pos[sym[pos] == a]
            pos = pos[sym[nxt[pos]] == b]
            if a == b and len(pos) > 1:  # in a run of equal symbols every second one is a left one
                linked = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
                starts = np.maximum.accumulate(np.where(linked, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - starts) % 2 == 0]
            if not len(pos):
                continue
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone] = self.made[r], -2
            nxt[pos], prv[after] = after, pos
            note(np.unique(np.concatenate([prv[pos], pos])))
        alive = sym != -2
        ids, kept = sym[alive], np.cumsum(alive)
        data, at = ids.astype("<u4").tobytes(), kept[stops] * 4
        return [data[s:e] for s, e in zip(at[:-1].tolist(), (at[1:] - 4).tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        find, cache = self.find, self.cache
        split = [[(self.added.get(x), find(x) if x not in self.added else ()) for x in self.special.split(t)] if self.special and self.special.search(t) else [(None, find(t))] for t in texts]
        if len(cache) > REMEMBERED:
            cache.clear()
        new = list({w for parts in split for _, ws in parts for w in ws}.difference(cache))
        plain = [w for w in new if "\0" not in w]
        if plain:
            cache.update(zip(plain, self.merge(plain), strict=True))
        for w in new:
            if "\0" in w:  # the joiner of merge() is in the word itself
                cache[w] = self.merge([w])[0]
        get = cache.__getitem__
        return [b"".join(b"".join(map(get, ws)) if i is None else i.to_bytes(4, "little") for i, ws in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded.

    One row for each input row, repeated ones too. A null text counts as an
    empty one: no ids, empty decoded text. Strings of added tokens in a text
    become those tokens. Other columns of docs are not read. A very long text
    or word is encoded whole, in time near its length.
    """

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                upto, size = at, 0
                while upto < batch.num_rows and (upto == at or size < BATCH_BYTES):
                    size += len(batch.column(1)[upto].as_py() or "")
                    upto += 1
                part = batch.slice(at, upto - at)
                ids = codec.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                at = upto

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), vocabulary()))


def digests(encoded: DataFrame, ids: bool = False) -> DataFrame:
    """The columns of encode_decode() as digests, with the ids themselves on demand."""
    return encoded.select("doc_id", "n_tokens", *(["ids"] if ids else []), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
