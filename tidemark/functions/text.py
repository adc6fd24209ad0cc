"""Tokens, hashes, text representations and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tokenizer's stop words, the labels' structural words.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with"]
STRUCTURAL = ["msg", "type", "source", "entity", "risk", "tech", "attack"]

#: Frequent English words that name no topic.
ENGLISH = sorted({
    *STOP, "about", "above", "after", "again", "against", "all", "also", "am", "any", "because", "been", "before", "being", "below", "between", "both", "but",
    "can", "cannot", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "further", "had", "have", "having", "her", "here", "hers", "herself",
    "him", "himself", "his", "how", "if", "into", "just", "may", "me", "more", "most", "must", "my", "myself", "no", "nor", "not", "now", "off", "once", "only",
    "or", "other", "our", "ours", "out", "over", "own", "same", "shall", "she", "should", "so", "some", "such", "than", "their", "theirs", "them", "then", "there",
    "these", "they", "this", "those", "through", "too", "under", "until", "up", "us", "very", "we", "were", "what", "when", "where", "which", "while", "who",
    "whom", "why", "would", "you", "your", "yours", "yourself",
})

TOKEN = r"(?U)\b[\w.\-/:]+\b"
TERM = r"(?U)\b\w\w+\b"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def tokens(text: Column | str, stop: list[str] = STOP) -> Column:
    """Lower-case runs of word characters and .-/: longer than 2 that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.char_length(t) > 2) & ~F.array_contains(strings(stop), t))


def terms(text: Column | str, stop: list[str] = ENGLISH) -> Column:
    """Lower-case words of two or more characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~F.array_contains(strings(stop), t))


def hash32(token: Column | str) -> Column:
    """The first 32 bits of a token's SHA-1."""
    return F.conv(F.substring(F.sha1(F.encode(_col(token), "UTF-8")), 1, 8), 16, 10).cast("long")


def hashed_vectors(df: DataFrame, key: str, tokens_: str, dim: int = 512, signed: bool = True, l2: bool = True) -> DataFrame:
    """key, slot, value: the non-zero entries of each row's hashing vector.

    Slot and sign come from the same hash, as in the published form; for an
    even dim even slots thus are never negative.
    """
    hashed = df.select(key, F.explode(tokens_).alias("t")).select(key, hash32("t").alias("h"))
    sign = F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0) if signed else F.lit(1.0)
    slots = hashed.groupBy(key, F.pmod("h", F.lit(dim)).alias("slot")).agg(F.sum(sign).alias("value")).filter("value <> 0")
    if not l2:
        return slots
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return slots.withColumn("value", F.col("value") / norm)


def hashing_vector(tokens_: Column | str, dim: int = 512, signed: bool = True, l2: bool = True) -> Column:
    """The dense hashing vector of an array of tokens; zeros for no tokens."""
    hashes = F.transform(_col(tokens_), lambda t: hash32(t))
    sign = (lambda h: F.when(h % 2 == 0, 1.0).otherwise(-1.0)) if signed else (lambda h: F.lit(1.0))
    zero = F.array_repeat(F.lit(0.0), dim)
    add = lambda acc, h: F.transform(acc, lambda v, i: F.when(i == F.pmod(h, F.lit(dim)), v + sign(h)).otherwise(v))
    raw = F.aggregate(hashes, zero, add)
    if not l2:
        return raw
    from tidemark.functions.vectors import unit

    return unit(raw)


def stable_id(*parts: Column, length: int = 16) -> Column:
    """A prefix of the SHA-1 of the parts joined by |; a null part is empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, length)


def context_pairs(context: Column | str, most: int = 6) -> Column:
    """k=v of the first keys of a JSON object in their order; of a repeated key the last value.

    A null prints as None. Values are JSON text: true stays true, nested values keep JSON form.
    """
    entries = F.map_entries(F.from_json(_col(context), "map<string,string>", {"mode": "PERMISSIVE"}))
    keys = F.slice(F.array_distinct(F.transform(entries, lambda e: e["key"])), 1, most)
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.coalesce(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(last(k), F.lit("None")))), F.array().cast("array<string>"))


def text_repr(include_tags: bool = True) -> Column:
    """The sentence that stands for a normalized event."""
    tag = lambda name, col: F.when(F.size(col) > 0, F.concat(F.lit(name + "="), F.array_join(col, ",")))
    pairs = context_pairs("context")
    parts = [
        F.concat(F.lit("[source="), "product", F.lit("]")),
        F.concat(F.lit("[type="), "event_type", F.lit("]")),
        F.concat(F.lit("[entity="), "asset_id", F.lit("]")),
        F.concat(F.lit("msg="), "msg"),
        F.when(F.size(pairs) > 0, F.array_join(pairs, " ")),
    ]
    if include_tags:
        parts += [tag("tech", "tech"), tag("attack", "attack"), tag("risk", "risk_tag")]
    return F.concat_ws(" ", *parts)


def norm(text: Column | str) -> Column:
    return F.lower(F.coalesce(_col(text), F.lit("")))


def contains_keyword(text: Column | str, keyword: str | Column) -> Column:
    keyword = keyword if isinstance(keyword, Column) else F.lit(keyword)
    return F.contains(norm(text), F.lower(keyword))


def contains_any(text: Column | str, keywords: Column | list[str]) -> Column:
    keywords = keywords if isinstance(keywords, Column) else strings(keywords)
    return F.exists(keywords, lambda k: F.contains(norm(text), k))


def keyword_hits(text: Column | str, keywords: Column | list[str]) -> Column:
    keywords = keywords if isinstance(keywords, Column) else strings(keywords)
    return F.size(F.filter(keywords, lambda k: F.contains(_col(text), k)))


def short_label(terms_text: Column | str) -> Column:
    """The first three terms that are not structural, or `cluster`."""
    plain = F.filter(F.split(F.translate(_col(terms_text), "[]',", "    "), r"\s+"), lambda t: (t != "") & ~F.array_contains(strings(STRUCTURAL), t))
    return F.when(F.size(plain) > 0, F.array_join(F.slice(plain, 1, 3), " ")).otherwise("cluster")


def term_distance(a: Column | str, b: Column | str) -> Column:
    """One minus the Jaccard similarity of two term sets; null if both are empty."""
    a, b = F.coalesce(_col(a), F.array().cast("array<string>")), F.coalesce(_col(b), F.array().cast("array<string>"))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1 - F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def top_terms(df: DataFrame, keys: list[str], text: str, n: int = 6, stop: list[str] = ENGLISH) -> DataFrame:
    """keys, terms: each group's most frequent terms, ties by the later term."""
    counts = df.select(*keys, F.explode(terms(text, stop)).alias("term")).groupBy(*keys, "term").count()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), F.desc("term")))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= n)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
