"""Interval join: pairs of rows from two tables whose intervals overlap, on any ordered scale.

A join on ``a.start < b.end AND b.start < a.end`` plans as a nested loop. Here both sides meet in
bins, by equality. A row's level is the smallest l for which its length is at most
``width * FAN ** l``; bins of level l are that wide, so an interval touches two of its own level's,
however long it is. A pair is found on the coarser of its two levels:

* left rows at their own level meet right rows of that and all finer levels, which repeat
  themselves at each coarser level that the left side has (two bins at most);
* right rows at their own level meet left rows of strictly finer levels, likewise.

Each pair comes out once, in the bin that holds the later of the two starts. Levels number a few
(they grow with the logarithm of the longest interval), so a row is repeated a few times, never
once a day or hour that it covers. Keys that must be equal join the bins' equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from riskflow.operators.materialize import materialize

FAN = 8
MOST_LEVELS = 22         # 8 ** 21 units cover a 64-bit scale


def _wide(width: int, level: int) -> int:
    return min(width * FAN ** level, 2 ** 62)


def _scale(df: DataFrame, name: str) -> Column:
    """A bound as a long: days of a date, microseconds of a timestamp, or the integer itself."""
    kind = df.schema[name].dataType
    if isinstance(kind, DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(F.to_timestamp(F.col(name).cast("timestamp")))
    if isinstance(kind, TimestampType):
        return F.unix_micros(name)
    return F.col(name).cast("long")


def _leveled(df: DataFrame, start: str, end: str, width: int, closed: bool) -> DataFrame:
    """Rows that can overlap anything, with their bounds (end exclusive) and level."""
    rows = df.withColumn("_s", _scale(df, start)).withColumn("_e", _scale(df, end) + (1 if closed else 0)).filter("_s < _e")
    level = F.lit(0)
    for l in range(MOST_LEVELS - 1, 0, -1):
        level = level + ((F.col("_e") - F.col("_s")) > F.lit(_wide(width, l - 1))).cast("int")
    return rows.withColumn("_level", level)


def _bin(value: Column, level: str, width: int) -> Column:
    """The bin of a value: floor division of longs, exact where doubles are not."""
    wide = F.element_at(F.array(*[F.lit(_wide(width, l)).cast("long") for l in range(MOST_LEVELS)]), F.col(level) + 1)
    return F.call_function("div", value - F.pmod(value, wide), wide)


def _binned(df: DataFrame, at: Column, width: int) -> DataFrame:
    """A row for each of its bins on each of the levels ``at`` (an array)."""
    return (df.withColumn("_at", F.explode(at))
            .withColumn("_bin", F.explode(F.sequence(_bin(F.col("_s"), "_at", width), _bin(F.col("_e") - 1, "_at", width)))))


def interval_join(left: DataFrame, right: DataFrame, left_bounds: Sequence[str], right_bounds: Sequence[str], width: int,
                  on: Sequence[tuple[str, str]] = (), closed: bool = False) -> DataFrame:
    """All pairs of overlapping rows: the columns of both sides, each pair once.

    Intervals are ``[start, end)``, or ``[start, end]`` if ``closed``; bounds are dates, timestamps or
    integers, of one kind on both sides. NULL or reversed bounds, and empty intervals, meet nothing.
    ``width`` is the finest bin, about a usual length (days, microseconds or the integers' unit); it
    changes speed only. ``on`` lists (left, right) columns that must be equal as well. Column names must not clash.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}")
    a = materialize(_leveled(left, *left_bounds, width, closed), "left-intervals")
    b = materialize(_leveled(right, *right_bounds, width, closed), "right-intervals")
    levels = {side: sorted(r[0] for r in df.select("_level").distinct().collect()) for side, df in (("a", a), ("b", b))}

    def pairs(own: DataFrame, other: DataFrame, at: list[int], strictly: bool) -> DataFrame:
        reach = F.filter(F.array(*[F.lit(l) for l in at]).cast("array<int>"),
                         lambda l: l > F.col("_level") if strictly else l >= F.col("_level"))
        x, y = _binned(own, F.array("_level"), width), _binned(other, reach, width)
        for c in ("_s", "_e", "_level", "_at", "_bin"):
            x, y = x.withColumnRenamed(c, "x" + c), y.withColumnRenamed(c, "y" + c)
        cond = (F.col("x_at") == F.col("y_at")) & (F.col("x_bin") == F.col("y_bin"))
        for l, r in on:
            cond = cond & (F.col(l) == F.col(r))
        met = x.join(y, cond).filter((F.col("x_s") < F.col("y_e")) & (F.col("y_s") < F.col("x_e"))
                                     & (F.col("x_bin") == _bin(F.greatest("x_s", "y_s"), "x_at", width)))
        return met.select(*left.columns, *right.columns)

    return pairs(a, b, levels["a"], False).unionByName(pairs(b, a, levels["b"], True))
