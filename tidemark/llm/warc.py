"""WARC archives: writing records, reading them back, assembling transactions."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, fresh, ship, stored, table

ship(__name__)

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 16 << 20
#: Bytes read at a time; what follows a member in them is copied once for each.
READ_BYTES = 64 << 10
#: Payloads of at least this many bytes may become revisits.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
READ = "record_id string, type string, concurrent_to string, uri string, date string, payload_digest string, payload_bytes long, status int, method string, fields map<string,string>"


def record(kind: str, record_id: str, uri: str, content_type: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    """One gzip member that holds one record."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE), *([("WARC-Target-URI", uri)] if uri else []), *extra, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def clean(value: str | None) -> str:
    """A header value: without line ends."""
    return " ".join((value or "").split())


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write request, response or revisit, and metadata records; the archives' names.

    pages: page_id, url, html, digest (hex SHA-1 of the payload), revisit
    (boolean). A null html is an empty payload, a null url leaves out the target.
    Archives have new names in every attempt of a task; those of an attempt
    that failed are in no manifest and are never read.
    """

    def run(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, n = None, "", 0
        made = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}")
                payload, uri = (row["html"] or "").encode(), clean(row["url"])
                ids = [str(uuid.uuid4()) for _ in range(3)]
                near = ("WARC-Concurrent-To", f"<urn:uuid:{ids[1]}>")
                digest = ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode())
                fields = "".join(f"{k}: {v}\r\n" for k, v in (("page_id", row["page_id"]), ("fetchTimeMs", 0)) if v is not None)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                out.write(record("request", ids[0], uri, "application/http; msgtype=request", f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode(), [near]))
                if row["revisit"]:
                    out.write(record("revisit", ids[1], uri, "application/http; msgtype=response", head, [digest, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]))
                else:
                    out.write(record("response", ids[1], uri, "application/http; msgtype=response", head + payload, [digest]))
                out.write(record("metadata", ids[2], uri, "application/warc-fields", fields.encode(), [near]))
                n += 3
                if out.tell() >= ARCHIVE_BYTES:
                    made.append((name, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            made.append((name, n, out.tell()))
            out.close()
        for name, n, size in made:
            yield pa.RecordBatch.from_pylist([{"archive": name, "n_records": n, "n_bytes": size}], schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return stored(pages.select("page_id", "url", "html", "digest", "revisit").mapInArrow(run, "archive string, n_records long, n_bytes long"), "warc-manifest")


def members(file):
    """The unpacked gzip members of a file, one after the other."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := file.read(READ_BYTES)):
            if parts:
                raise ValueError("an archive ends within a record")
            return
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            data = unpacker.unused_data
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parsed(member: bytes) -> dict:
    """A record's row; its payload's length and SHA-1 are those of the stored bytes."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(named["content-length"])]
    row = {"record_id": named["warc-record-id"], "type": named["warc-type"], "concurrent_to": named.get("warc-concurrent-to"), "uri": named.get("warc-target-uri"), "date": named.get("warc-date")}
    if row["type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        row["status"] = int(http.split(b" ", 2)[1])
    if row["type"] == "response":
        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        if named.get("warc-payload-digest", "").startswith("sha1:") and base64.b32decode(named["warc-payload-digest"][5:]).hex() != row["payload_digest"]:
            raise ValueError(f"{row['record_id']}: the payload has another digest than its header")
    elif row["type"] == "revisit":
        row["payload_digest"] = base64.b32decode(named["warc-payload-digest"][5:]).hex()
    elif row["type"] == "request":
        row["method"] = block.split(b" ", 1)[0].decode("ascii", "replace")
    elif named.get("content-type") == "application/warc-fields":
        row["fields"] = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
    return row


def records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the archives that the manifest names."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("status", pa.int32()), ("method", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}") as file:
                    rows = []
                    for member in members(file):
                        rows.append(parsed(member))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("archive").repartition(n, "archive").mapInArrow(run, READ)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response and metadata structs.

    Requests and metadata point to their response or revisit by
    WARC-Concurrent-To. A capture without a request or metadata has null there;
    of several, that with the least record id is taken. Requests and metadata
    that point to no capture are left out.
    """
    capture = found.filter(F.col("type").isin("response", "revisit")).select("record_id", F.struct("type", "uri", "date", "status", "payload_digest", "payload_bytes").alias("response"))
    side = found.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()).select(
        F.col("concurrent_to").alias("record_id"),
        F.when(F.col("type") == "request", F.struct(F.col("record_id").alias("id"), "method", "uri", "date")).alias("request"),
        F.when(F.col("type") == "metadata", F.struct(F.col("record_id").alias("id"), "fields")).alias("metadata"),
    )
    side = side.groupBy("record_id").agg(F.min_by("request", "request.id").alias("request"), F.min_by("metadata", "metadata.id").alias("metadata"))
    return capture.join(side, "record_id", "left")


def marked(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages with digest and revisit: whether an equal payload has a larger page_id.

    Payloads under `least` bytes never are revisits. Repeated rows with the
    largest page_id are all responses. A null page_id is smaller than any
    other; where no row of a payload has one, all are responses.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"))
    sized = pages.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).filter(F.col("n") >= least)
    last = sized.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null").drop("n")
    again = sized.join(last, "digest").filter(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest")).distinct()
    return pages.join(again, (pages["digest"] == F.col("again_digest")) & pages["page_id"].eqNullSafe(F.col("again_id")), "left").select("page_id", "url", "html", "digest", F.col("again_digest").isNotNull().alias("revisit"))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive the pages, read the archives back, and assemble the captures."""
    folder = folder or fresh(pages.sparkSession, "warc")
    found = stored(records(write(marked(pages), folder), folder), "warc-records")
    return stored(transactions(found), "warc-captures")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the captures say of each page; a revisit's payload is its response's."""
    flat = round_trip(table(spark, sf_dir, "pages")).select(
        F.col("metadata.fields")["page_id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.uri").alias("uri"), F.col("request.method").alias("method")
    )
    full = flat.filter((F.col("record_type") == "response") & (F.col("own_bytes") >= REVISIT_BYTES)).groupBy("payload_digest").agg(F.max("page_id").alias("full_id"), F.max("own_bytes").alias("full_bytes"))
    again = F.col("record_type") == "revisit"
    return flat.join(full, "payload_digest", "left").select(
        "page_id", F.when(again, F.col("full_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.when(again, F.col("full_id")).alias("refers_to"), "uri", "method"
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, url FROM pages),
s AS (SELECT page_id, url, octet_length(encode(body)) AS n, sha1(body) AS d FROM p),
m AS (SELECT d, max(page_id) AS last, count(*) AS c FROM s WHERE n >= 1000 GROUP BY d)
SELECT s.page_id, s.n AS payload_bytes, s.d AS payload_digest,
       CASE WHEN c > 1 AND last IS DISTINCT FROM s.page_id AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND last IS DISTINCT FROM s.page_id AND last IS NOT NULL THEN last END AS refers_to,
       trim(regexp_replace(url, '\\s+', ' ', 'g')) AS uri, 'GET' AS method
FROM s LEFT JOIN m ON s.d = m.d AND s.n >= 1000
"""
