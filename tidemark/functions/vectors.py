"""Vector arithmetic on array columns, and aggregates of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def rounded(x: Column | str, digits: int) -> Column:
    """x rounded half away from zero; what rounds to zero keeps its sign, as in SQL engines that round doubles.

    F.round goes by way of a decimal, which has no negative zero.
    """
    x = _col(x)
    return F.when((x < 0) & (F.round(x, digits) == 0), F.lit(-0.0)).otherwise(F.round(x, digits))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def square_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """The vector of length one in its direction; a vector without length as it is."""
    own = F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n")))  # the length is found once, not per element
    return F.get(F.transform(own, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x))), 0)


def vector_sums(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """keys, n, sums: counts and elementwise sums, combined before the shuffle."""
    at = [F.sum(F.get(doubles(vector), i)).alias(f"_{i}") for i in range(dim)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *at).select(*keys, "n", F.array(*(F.col(f"_{i}") for i in range(dim))).alias("sums"))


def centroids(df: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """keys, size, centroid: the mean vector of each group; rows without a vector count in size alone."""
    at = [F.avg(F.get(doubles(vector), i)).alias(f"_{i}") for i in range(dim)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *at).select(*keys, "size", F.array(*(F.col(f"_{i}") for i in range(dim))).alias("centroid"))


def wss(df: DataFrame, keys: list[str], label: str, vector: str, dim: int) -> DataFrame:
    """keys, wss: squared distances to the cluster means, from sums alone.

    The sum over a cluster is that of the squares less the squared sum over its size.
    """
    own = df.withColumn("_sq", dot(vector, vector))
    sums = vector_sums(own, [*keys, label], vector, dim)
    squares = own.groupBy(*keys, label).agg(F.sum("_sq").alias("sq"))
    per = sums.join(squares, [*keys, label]).select(*keys, (F.col("sq") - dot("sums", "sums") / F.col("n")).alias("w"))
    return per.groupBy(*keys).agg(F.sum(F.greatest("w", F.lit(0.0))).alias("wss"))


def silhouette(df: DataFrame, keys: list[str], label: str, vector: str, dim: int) -> DataFrame:
    """keys, silhouette: the mean cosine silhouette of given clusters.

    The mean distance of a vector to a cluster is one less its dot product with
    the sum of the cluster's unit vectors over the cluster's size, so each row
    meets its key's array of cluster sums and no other row; rows aren't shuffled
    by cluster. Rows alone in a cluster count 0.
    """
    rows = df.select(*keys, F.col(label).alias("own"), unit(vector).alias("u"))
    sums = vector_sums(rows, [*keys, "own"], "u", dim)
    clusters = sums.groupBy(*keys).agg(F.collect_list(F.struct("own", "n", "sums")).alias("cs"))  # a few for each key
    both = rows.join(clusters, keys) if keys else rows.crossJoin(F.broadcast(clusters))
    near = F.transform("cs", lambda c: F.struct((c["own"] == F.col("own")).alias("same"), c["n"].alias("n"), dot("u", c["sums"]).alias("near")))
    each = both.select(*keys, near.alias("d")).filter(F.size("d") > 1)
    own = F.get(F.filter("d", lambda x: x["same"]), 0)
    each = each.select(*keys, own.alias("own"), F.array_min(F.transform(F.filter("d", lambda x: ~x["same"]), lambda x: 1 - x["near"] / x["n"])).alias("b"))
    a = (F.col("own.n") - F.col("own.near")) / (F.col("own.n") - 1)
    value = F.when(F.col("own.n") == 1, 0.0).otherwise((F.col("b") - a) / F.greatest(a, F.col("b"), F.lit(1e-300)))
    return each.groupBy(*keys).agg(F.avg(value).alias("silhouette"))
