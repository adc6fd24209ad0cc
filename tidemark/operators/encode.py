"""Text encoders: a hashing one, and a slot for others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import text_repr, tokens

#: texts -> matrix; made once in each worker.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hash_tokens(lists: list[list[str]], dim: int, signed: bool = True, l2: bool = True) -> np.ndarray:
    """Hashing vectors, a row for each list of tokens."""
    import hashlib

    out = np.zeros((len(lists), dim))
    known: dict[str, int] = {}
    for row, found in zip(out, lists, strict=True):
        for t in found:
            if t not in known:
                known[t] = int(hashlib.sha1(t.encode()).hexdigest()[:8], 16)
            h = known[t]
            row[h % dim] += -1.0 if signed and h & 1 else 1.0
    if l2:
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, norms, out=out, where=norms > 0)
    return out


def hashed(df: DataFrame, text: str, dim: int = 384, dtype: str = "float32") -> DataFrame:
    """df with vector, from a text's hashed tokens; dtype rounds, storage is double."""

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in parts:
            yield pd.Series(list(hash_tokens([list(x) for x in lists], dim).astype(dtype).astype(float)), index=lists.index)

    return df.withColumn("vector", vectors(tokens(text)))


def embed(events: DataFrame, dim: int = 384, dtype: str = "float32", include_tags: bool = True) -> DataFrame:
    """events with text_repr and its vector."""
    return hashed(events.withColumn("text_repr", text_repr(include_tags)), "text_repr", dim, dtype)


def embed_with(events: DataFrame, encoder: Encoder, dtype: str = "float32", include_tags: bool = True) -> DataFrame:
    """The same with a model that each worker loads once."""

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in parts:
            v = np.asarray(encode(texts.tolist()), float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(v, n, out=v.copy(), where=n > 0).astype(dtype).astype(float)), index=texts.index)

    return events.withColumn("text_repr", text_repr(include_tags)).withColumn("vector", vectors("text_repr"))


def query_vector(text: str, dim: int = 384) -> list[float]:
    """A query's vector by the same hashing, on the driver."""
    import re

    from tidemark.functions.text import STOP, TOKEN

    found = [t for t in re.findall(TOKEN.removeprefix("(?U)"), text.lower()) if len(t) > 2 and t not in STOP]
    return hash_tokens([found], dim)[0].tolist()
