"""Week keys and recency, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_week(ts: Column | str) -> Column:
    """YYYY-Www by ISO year and week."""
    ts = _col(ts)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def iso_week_number(ts: Column | str) -> Column:
    """ISO year * 100 + ISO week, which keeps years apart."""
    ts = _col(ts)
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)).cast("long")


def sunday_week(ts: Column | str) -> Column:
    """Calendar year and the week 00-53 that begins on Sundays."""
    d = F.to_date(_col(ts))
    week = F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def week_sort_key(week: Column | str) -> Column:
    """YYYY-Www as year * 100 + week; -1 for anything else."""
    week = _col(week)
    part = lambda i: F.get(F.split(week, "-W"), i).try_cast("int")
    return F.coalesce(part(0) * 100 + part(1), F.lit(-1))


def week_label(ts: Column | str, product: Column | str) -> Column:
    """[W14] product, by the ISO week's number."""
    return F.concat(F.lit("[W"), F.weekofyear(_col(ts)).cast("string"), F.lit("] "), _col(product))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column | str, now: Column) -> Column:
    return (micros(now) - micros(_col(ts))) / F.lit(float(DAY_MICROS))


def recency(ts: Column | str, now: Column, half_life_days: float | Column = 14.0) -> Column:
    """0.5 ** (age / half life): 1 for now and later, 0 for no timestamp."""
    half = half_life_days if isinstance(half_life_days, Column) else F.lit(float(half_life_days))
    return F.when(_col(ts).isNull(), 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days(ts, now)) / half))


def fused(sim: Column, recent: Column, alpha: float | Column = 0.7) -> Column:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return alpha * sim + (1 - alpha) * recent
