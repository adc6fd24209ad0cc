"""Sharding by extendible hashing: only oversized buckets split on another bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, stored, table

#: Bytes of text that a shard may hold, and shards that there are at least, so that small tables are spread too.
SHARD_BYTES, SHARDS = 64 << 20, 16
#: Bits of the hash. Keys whose hashes agree in all of them share a bucket that splits by its rows.
HASH_BITS = 60
#: Bits that one round looks ahead.
ROUND_BITS = 6


def key_hash(*keys: str) -> Column:
    """The first 60 bits of the MD5 of the keys as text."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(hashed: Column, bits: Column | int) -> Column:
    """The first `bits` bits of a hash, as a number."""
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", hashed, (F.lit(HASH_BITS) - bits).cast("int")))


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The leaves of the bucket tree: depth, bucket, bytes, n_rows.

    sizes: h (60-bit hash), bytes, n_rows, summed over equal hashes or not.
    Every round sums bytes by the next few bits for rows of buckets that are
    still too large, which a map-side sum reduces to a few numbers a bucket,
    and then finds for each of them the shortest prefix within the limit. A
    bucket at depth HASH_BITS may be over the limit: its rows share one hash.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    leaves = None
    if total <= limit:
        return sizes.agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")).filter("n_rows > 0").select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"), "bytes", "n_rows")
    done, rest = 0, sizes
    while True:
        ahead = min(HASH_BITS, max(done, math.ceil(math.log2(max(1, total / limit))) if not done else 0) + ROUND_BITS)
        fine = rest.groupBy(prefix(F.col("h"), ahead).alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        fine = stored(fine, "shard-sizes")
        levels = fine.select("p", "bytes", "n_rows", F.explode(F.sequence(F.lit(done), F.lit(ahead))).alias("depth"))
        nodes = levels.groupBy("depth", F.call_function("shiftright", F.col("p"), (F.lit(ahead) - F.col("depth")).cast("int")).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        nodes = stored(nodes, "shard-nodes")
        large = nodes.filter((F.col("bytes") > limit) & (F.col("n_rows") > 1))
        parents = large.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
        found = nodes.join(parents, ["depth", "bucket"], "left_semi").filter((F.col("bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == HASH_BITS))
        leaves = found if leaves is None else leaves.unionByName(found)
        open_ = large.filter((F.col("depth") == ahead) & (F.col("depth") < HASH_BITS)).select(F.col("bucket").alias("b"))
        if ahead == HASH_BITS or open_.isEmpty():
            return leaves
        rest = rest.join(open_, prefix(F.col("h"), ahead) == F.col("b"), "left_semi")
        done = ahead


def assign(docs: DataFrame, limit: int = SHARD_BYTES, keys: tuple[str, ...] = ("doc_id",), text: str = "text", carry: bool = False) -> DataFrame:
    """The rows' keys and shards: *keys, n_bytes, shard, depth, shard_bytes, shard_rows.

    shard is the bucket's bits (`*` at depth 0), so that shards are the leaves
    of a prefix tree and the directory of the deepest depth maps every hash to
    one. No shard is over the limit, except that of a single row which is.
    With carry, _row has all columns of the row.

    Null keys hash like a value of their own; a null text has no bytes. Rows
    whose keys are equal, however many, share a hash that no bit parts: a
    bucket of one hash that is too large is cut into runs of rows (`bits.n`).
    Two runs over the same rows agree.
    """
    own = ["_row"] if carry else []
    given = docs.select(*keys, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), key_hash(*keys).alias("h"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), *(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(r) for r in own))
    rows = stored(given.drop(*own), "shard-rows")
    leaves = stored(directory(rows.select("h", F.col("n_bytes").alias("bytes"), F.lit(1).cast("long").alias("n_rows")), limit), "shard-leaves")
    rows = given if carry else rows
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]
    # at most HASH_BITS + 1 depths: a row is in exactly one leaf, that at the one depth where its prefix is one
    tries = F.array(*(F.struct(F.lit(d).alias("depth"), prefix(F.col("h"), d).alias("bucket")) for d in sorted(depths)))
    placed = rows.withColumn("try", F.explode(tries)).select(*keys, "n_bytes", "h", "tie", *own, "try.*") if depths else rows.withColumns({"depth": F.lit(0), "bucket": F.lit(0).cast("long")})
    placed = placed.join(leaves.select("depth", "bucket", F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows")), ["depth", "bucket"])
    bits = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.lpad(F.bin("bucket"), F.col("depth"), F.lit("0")))
    placed = placed.withColumn("shard", bits)
    whole = placed.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    columns = [*keys, "n_bytes", "shard", "depth", "shard_bytes", "shard_rows", *own]
    if leaves.filter((F.col("bytes") > limit) & (F.col("n_rows") > 1)).isEmpty():
        return whole.select(*columns)
    return whole.select(*columns).unionByName(runs(placed.filter((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)), limit).select(*columns))


def runs(rows: DataFrame, limit: int) -> DataFrame:
    """Cut each bucket of one hash into runs of rows within the limit.

    Rows are dealt to cells by a hash of their text's and of their number among
    equal rows, with a quarter of the limit a cell on average; a cell that is
    too large is cut row by row. Only a cell's rows meet in one task.
    """
    parts = F.greatest(F.lit(1), F.ceil(4 * F.col("shard_bytes") / limit))
    spread = numbered(rows, "h", "tie", "n_bytes").withColumn("cell", F.pmod(F.xxhash64("tie", "_ord"), parts))
    order = Window.partitionBy("shard", "cell").orderBy("tie", "n_bytes", "_ord").rowsBetween(Window.unboundedPreceding, -1)
    # a run takes rows while the sum before them is under half the limit; a row of over half a limit is alone
    big = F.col("n_bytes") > limit // 2
    before = F.coalesce(F.sum(F.when(~big, F.col("n_bytes")).otherwise(0)).over(order), F.lit(0))
    solo = F.coalesce(F.sum(big.cast("long")).over(order), F.lit(0))
    cut = spread.withColumn("part", F.when(big, F.concat(F.lit("b"), solo.cast("string"))).otherwise(F.floor(before / (limit // 2)).cast("string")))
    cut = cut.withColumn("shard", F.concat("shard", F.lit("."), F.col("cell").cast("string"), F.lit("."), F.col("part")))
    cut = stored(cut.drop("shard_bytes", "shard_rows", "_ord"), "shard-runs")
    return cut.join(cut.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")), "shard")


def write_shards(docs: DataFrame, place: str, limit: int = SHARD_BYTES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Write each shard's rows as a folder of Parquet files under `place`; the assignment.

    The shard is the partition column `_shard`, with more underscores before it
    where docs has a column of that name. Every row is written to its own
    shard, one task a shard.
    """
    name = "_shard"
    while name in docs.columns:
        name = "_" + name
    rows = assign(docs, limit, keys, carry=True).select(*(F.col("_row")[c].alias(c) for c in docs.columns), F.col("shard").alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(place)
    return assign(docs, limit, keys)


def shard_limit(docs: DataFrame, text: str = "text") -> int:
    """SHARD_BYTES, or less if there were fewer than SHARDS shards."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(SHARD_BYTES, max(1, -(-total // SHARDS)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assign(docs, shard_limit(docs))


ORACLE = """
WITH lim AS (SELECT least(67108864, greatest(1, ceil(sum(octet_length(encode(text))) / 16.0)))::BIGINT AS lim FROM documents),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT depth::INTEGER AS depth, (h >> (60 - depth)) AS bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
      FROM d CROSS JOIN range(0, 61) r(depth) GROUP BY ALL),
l AS (SELECT d.doc_id, min(n.depth) AS depth FROM d JOIN n ON (d.h >> (60 - n.depth)) = n.bucket
      WHERE n.shard_bytes <= (SELECT lim FROM lim) OR n.shard_rows = 1 OR n.depth = 60 GROUP BY d.doc_id)
SELECT d.doc_id, n_bytes, CASE WHEN l.depth = 0 THEN '*' ELSE lpad(bin(n.bucket), l.depth, '0') END AS shard, l.depth, shard_bytes, shard_rows
FROM d JOIN l ON d.doc_id = l.doc_id JOIN n ON n.depth = l.depth AND n.bucket = (d.h >> (60 - l.depth))
"""
