"""Column helpers: binding, predicates on doubles, guarded statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once inside a higher-order function."""
    return F.transform(F.array(value), body)[0]


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite; NaN is tested first, as Spark orders it above every number."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def tradable(x: Column) -> Column:
    """Finite and positive."""
    return finite(x) & (x > 0)


def wall_clock(told: Column) -> Column:
    """The local wall time of an ISO text, whatever offset or Z stands behind it; no session time zone moves it."""
    offset = r"^(.*:[0-9]{2}(?:\.[0-9]+)?)\s*(?:Z|[+-][0-9]{2}(?::?[0-9]{2}){0,2})$"
    return F.regexp_replace(told.cast("string"), offset, "$1").cast("timestamp_ntz")


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate; null for fewer than two rows and for a constant side."""
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    a, b = F.when(both == 1, x), F.when(both == 1, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))


def iso(ts: Column) -> Column:
    """ISO text of a naive timestamp: microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    parts = F.date_format(ts, "SSSSSS")
    return F.when(parts == "000000", whole).otherwise(F.concat(whole, F.lit("."), parts))
