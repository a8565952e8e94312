"""Half-open intervals with optional ends. A null start is minus infinity, a null end plus infinity.

This module alone compares bounds. The ``IS NULL OR`` form is kept as it is pushed into Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def contains(start, end, at) -> Column:
    start, end, at = _c(start), _c(end), _c(at)
    return (start.isNull() | (start <= at)) & (end.isNull() | (end > at))


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Adjacent intervals do not overlap."""
    a_start, a_end, b_start, b_end = map(_c, (a_start, a_end, b_start, b_end))
    return (a_start.isNull() | b_end.isNull() | (a_start < b_end)) & (b_start.isNull() | a_end.isNull() | (b_start < a_end))


def starts_before(a_start, b_start) -> Column:
    a, b = _c(a_start), _c(b_start)
    return F.coalesce((a.isNull() & b.isNotNull()) | (a < b), F.lit(False))


def extends_beyond(a_end, b_end) -> Column:
    a, b = _c(a_end), _c(b_end)
    return F.coalesce((a.isNull() & b.isNotNull()) | (a > b), F.lit(False))


def is_valid(start, end) -> Column:
    start, end = _c(start), _c(end)
    return start.isNull() | end.isNull() | (start < end)


def is_always(start, end) -> Column:
    return _c(start).isNull() & _c(end).isNull()


def duration_us(start, end) -> Column:
    """Microseconds, null when unbounded."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def text(start, end) -> Column:
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    one = lambda c, none: F.coalesce(F.date_format(c, fmt), F.lit(none))
    return F.concat(F.lit("["), one(_c(start), "-∞"), F.lit(", "), one(_c(end), "∞"), F.lit(")"))


def intent_name(intent) -> Column:
    i = _c(intent)
    return F.when(i == 0, "assert").when(i == 1, "correction").when(i == 2, "remainder").otherwise(F.concat(F.lit("intent("), i.cast("string"), F.lit(")")))
