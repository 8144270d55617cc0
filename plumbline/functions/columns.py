"""Column expressions with the pandas meaning where Spark's differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_numeric(c: Column | str, coerce: bool = False) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("double") if coerce else col.cast("double")


def to_datetime(c: Column | str, coerce: bool = False) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("timestamp_ntz") if coerce else col.cast("timestamp_ntz")


def sum_or_zero(c: Column | str) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def nunique(c: Column | str, dropna: bool = True) -> Column:
    """Distinct values; without dropna, null is one of them where it occurs."""
    col = F.col(c) if isinstance(c, str) else c
    distinct = F.count_distinct(col)
    return distinct if dropna else distinct + F.coalesce(F.bool_or(col.isNull()), F.lit(False)).cast("long")


def mode_first(c: str, order: str, last: bool = False) -> Column:
    """The value of c in the row that comes first (or last) by order."""
    return F.max_by(c, order) if last else F.min_by(c, order)
