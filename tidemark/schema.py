"""Schemas of the engine's tables."""

from pyspark.sql import types as T

_str, _strs = T.StringType(), T.ArrayType(T.StringType())


def _of(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


EVENTS = _of(("event_id", _str), ("ts", T.TimestampType()), ("product", _str), ("event_type", _str), ("asset_id", _str), ("msg", _str), ("context", _str), ("tech", _strs), ("attack", _strs), ("risk_tag", _strs))
EMBEDDED = T.StructType([*EVENTS.fields, T.StructField("text_repr", _str), T.StructField("vector", T.ArrayType(T.DoubleType()))])
CLUSTERS = _of(("week", _str), ("cluster_id", _str), ("label", T.IntegerType()), ("size", T.LongType()), ("terms", _strs), ("centroid", T.ArrayType(T.DoubleType())))
CLUSTERS_CSV = _of(("week", _str), ("cluster_id", _str), ("size", T.LongType()), ("terms", _str))
TRENDS = _of(("week", _str), ("type", _str), ("cluster_id", _str), ("delta_size", T.LongType()), ("drift", T.DoubleType()), ("label", _str))
TIMELINE = _of(("week", _str), ("logon", T.LongType()), ("logoff", T.LongType()))
ASSIGNMENT_COLUMNS = ["event_id", "ts", "product", "event_type", "asset_id", "text_repr", "cluster_id"]
