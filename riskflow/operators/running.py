"""Running totals over ordered partitions, and totals that restart at each success."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_window(partition: Sequence[str | Column], order: Sequence[str | Column]):
    """``ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW`` over a total order."""
    return (Window.partitionBy(*partition).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def whole_partition(partition: Sequence[str | Column]):
    return Window.partitionBy(*partition)


def with_running(df: DataFrame, partition, order, sums: dict[str, Column]) -> DataFrame:
    """Add running sums; all share one window spec, so Spark sorts once."""
    w = running_window(partition, order)
    return df.withColumns({name: F.sum(expr).over(w) for name, expr in sums.items()})


def with_segment_running(df: DataFrame, key: str, segment: str, order,
                         sums: dict[str, Column]) -> DataFrame:
    """Running sums that restart whenever ``segment`` (a running counter) changes.

    The segment id is itself a running count (e.g. successes so far), so the row
    that carries a success opens the new segment.
    """
    return with_running(df, [key, segment], order, sums)
