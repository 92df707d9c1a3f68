"""Validity intervals (SCD2 rows): as-of slices, day expansion and calendar spines."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.dates import lit_date


def as_of_slice(df: DataFrame, as_of, start: str = "currentdate", end: str = "nextdate",
                closed: str = "left") -> DataFrame:
    """Rows valid on ``as_of``: ``[start, end)`` when closed='left', ``(start, end]`` when 'right'."""
    d = lit_date(as_of) if not isinstance(as_of, Column) else as_of
    if closed == "left":
        cond = (F.col(start) <= d) & (d < F.col(end))
    elif closed == "right":
        cond = (F.col(start) < d) & (d <= F.col(end))
    else:
        raise ValueError(closed)
    return df.filter(cond)


def explode_days(df: DataFrame, day_col: str, window_start, window_end,
                 start: str = "currentdate", end: str = "nextdate",
                 closed: str = "right") -> DataFrame:
    """One row per covered calendar day inside ``[window_start, window_end]``.

    Replaces the range join ``cal.day > start AND cal.day <= end`` (which Spark
    plans as a nested-loop join) with a per-row ``sequence`` clipped to the
    reporting window first, so the output is bounded by rows x window days and
    nothing is shuffled. Reversed bounds are filtered out before ``sequence``
    (which would otherwise count downwards).
    """
    ws, we = lit_date(window_start), lit_date(window_end)
    # Plain predicates on the stored bounds first: a scan can prune by them.
    if closed == "right":
        df = df.filter((F.col(start) < we) & (F.col(end) >= ws))
        lo, hi = F.date_add(F.col(start), 1), F.col(end)
    elif closed == "left":
        df = df.filter((F.col(start) <= we) & (F.col(end) > ws))
        lo, hi = F.col(start), F.date_sub(F.col(end), 1)
    else:
        raise ValueError(closed)
    lo = F.when(lo > ws, lo).otherwise(ws)
    hi = F.when(hi < we, hi).otherwise(we)
    return (df.withColumn("_lo", lo).withColumn("_hi", hi)
              .filter(F.col("_lo") <= F.col("_hi"))
              .withColumn(day_col, F.explode(F.sequence(F.col("_lo"), F.col("_hi"))))
              .drop("_lo", "_hi"))


def calendar(spark: SparkSession, first, last, day_col: str = "caldate") -> DataFrame:
    """Calendar dimension: one row per day with its weekday name.

    Generated from a range, so it costs one row per day whatever the data size.
    """
    f = first if isinstance(first, _dt.date) else _dt.date.fromisoformat(first)
    n = ((last if isinstance(last, _dt.date) else _dt.date.fromisoformat(last)) - f).days + 1
    return (spark.range(max(n, 0))
            .select(F.date_add(F.lit(f), F.col("id").cast("int")).alias(day_col))
            .withColumn("weekdaylong", F.date_format(day_col, "EEEE")))
