"""Media columns: content-addressed payloads in tar shards, read back by ranges.

A text's bytes, padded with zero bytes to whole rows of 64, are the samples of
an 8-bit grayscale PNG 64 pixels wide. Images lie in tar shards in the shared
folder; rows hold digest, shard, offset and length only.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, fresh, ship, stored, table

ship(__name__)

WIDTH = 64
#: A shard is closed once it has this many bytes.
SHARD_BYTES = 64 << 20
#: Bytes of one reader task: a shard's members are read in pieces of about this size.
READ_BYTES = 16 << 20
HEADER_BYTES = 33


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def png(payload: bytes) -> bytes:
    """A lossless 8-bit grayscale image of the payload; equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from an image's first 33 bytes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def pixels(data: bytes) -> bytes:
    """The samples of an image that png() made."""
    width, height, _ = header(data)
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def member_header(name: str, size: int) -> bytes:
    """A ustar header block."""
    block = bytearray(512)
    octal = lambda n, digits: b"%0*o\0" % (digits - 1, n)
    size_field = octal(size, 12) if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")
    for at, field in ((0, name.encode()), (100, octal(0o644, 8)), (108, octal(0, 8)), (116, octal(0, 8)), (124, size_field), (136, octal(0, 12)), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000")):
        block[at : at + len(field)] = field
    block[148:156] = b"%06o\0 " % sum(block)
    return bytes(block)


def store(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Write payloads to tar shards; doc_id, n_bytes, digest, shard, offset, length.

    One row for each input row. A null text counts as an empty one, whose
    payload is 64 zero bytes. Each task writes a payload once, however many
    rows have it, into shards of its own; index() then picks one location for
    each digest. A shard's name is new for every attempt of a task, and only
    rows of the attempt that succeeded name it.
    """

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        where: dict[bytes, tuple[str, int, int]] = {}
        out, shard = None, ""
        try:
            for batch in batches:
                rows = []
                for text in batch.column(1):
                    data = (text.as_py() or "").encode()
                    payload = padded(data)
                    key = hashlib.sha256(payload).digest()
                    if key not in where:
                        if out is None or out.tell() >= SHARD_BYTES:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            shard = f"{uuid.uuid4().hex}.tar"
                            out = fs.open_output_stream(f"{base}/{shard}")
                        image = png(payload)
                        out.write(member_header(f"{key.hex()}.png", len(image)))
                        where[key] = (shard, out.tell(), len(image))
                        out.write(image + bytes(-len(image) % 512))
                    rows.append((len(data), key.hex(), *where[key]))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long")
    return stored(rows, "media-rows")


def index(rows: DataFrame) -> DataFrame:
    """One location for each digest: the least (shard, offset)."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def metadata(objects: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """objects with width, height, bits, media_bytes from header-only range reads.

    With payloads, each object is then read whole, and its digests, checksum
    and feature are added: the mean and the entropy of its samples and an
    8 x 8 bit map of which bands of the image are brighter than its mean.
    Raises if stored bytes do not have the digest they are filed under.
    """

    def run(batches):
        fs, base = filesystem(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["shard"], fs.open_input_file(f"{base}/{row['shard']}")
                width, height, bits = header(file.read_at(HEADER_BYTES, row["offset"]))
                made = row | {"media_bytes": row["length"], "width": width, "height": height, "bits": bits}
                if payloads:
                    data = file.read_at(row["length"], row["offset"])
                    payload = pixels(data)
                    sha = hashlib.sha256(payload).hexdigest()
                    if sha != row["digest"]:
                        raise ValueError(f"{name} at {row['offset']} is damaged")
                    made |= {"payload_bytes": len(payload), "payload_sha256": sha, "tail_crc32": zlib.crc32(payload[-WIDTH:]), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature(payload)}
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if file is not None:
            file.close()

    fields = [("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("media_bytes", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32())]
    if payloads:
        fields += [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(fields)
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int"}
    pieces = objects.repartition("shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")
    return pieces.mapInArrow(run, ", ".join(f"{n} {kinds[k]}" for n, k in fields))


def feature(payload: bytes) -> str:
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = -float(np.sum(share[share > 0] * np.log2(share[share > 0])))
    rows = samples.reshape(-1, 8, 8).sum(axis=2, dtype=np.int64)  # sums of 8 pixels, 8 a row
    cuts = np.linspace(0, len(rows), 9).astype(int)
    total = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(rows, axis=0)])
    height = np.maximum(np.diff(cuts), 1)[:, None]
    bands = np.diff(total[cuts], axis=0) / (8 * height)
    mean = float(samples.mean())
    bits = np.packbits((bands > mean).ravel()).tobytes().hex()
    return f"mean={mean:.4f};entropy={entropy:.4f};map={bits}"


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text and join each row with what reading its object back gives.

    Rows: doc_id, n_bytes, digest, shard, offset, length (the chosen location)
    and the columns of metadata(). Repeated rows stay repeated.
    """
    folder = folder or fresh(docs.sparkSession, "media")
    rows = store(docs, folder)
    objects = stored(metadata(index(rows), folder), "media-objects")
    return rows.select("doc_id", "n_bytes", "digest").join(objects, "digest")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )
