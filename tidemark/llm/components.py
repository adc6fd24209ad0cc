"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """v, root: the least vertex of each vertex's component; edges: u, v (longs).

    Alternates large and small stars until the edges stay as they are. Each
    step is a minimum per vertex, combined before the shuffle, and a join; no
    neighbourhood is ever gathered. Vertices without an edge are left out.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = stored(edges, "edges"), None
    for _ in range(rounds):
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(edges.select("v", F.col("v").alias("root")).distinct())
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = stored(small, "edges")
    raise RuntimeError("components did not settle")
