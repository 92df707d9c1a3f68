"""Date semantics.

T-SQL ``DATEDIFF(month|year, a, b)`` counts calendar boundaries crossed, not
whole periods; Spark's ``months_between``/3-arg ``datediff`` count whole periods,
so the boundary forms are built from ``year``/``month``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(c) -> Column:
    """``CONVERT(date, x)`` for timestamps, dates, or ISO strings."""
    return F.to_date(_col(c))


def lit_date(d) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def day_diff(start, end) -> Column:
    """``DATEDIFF(day, start, end)``: midnights crossed between the two dates."""
    return F.datediff(as_date(end), as_date(start))


def month_boundaries(start, end) -> Column:
    """``DATEDIFF(month, start, end)``: month boundaries crossed."""
    s, e = as_date(start), as_date(end)
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def year_boundaries(start, end) -> Column:
    """``DATEDIFF(year, start, end)``: year boundaries crossed."""
    return F.year(as_date(end)) - F.year(as_date(start))


def yyyymm(c) -> Column:
    """``CAST(YEAR(d) AS varchar) + RIGHT('0' + CAST(MONTH(d) AS varchar), 2)``."""
    return F.date_format(as_date(c), "yyyyMM")
