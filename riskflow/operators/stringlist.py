"""Ordered distinct string aggregation: the values of a group as one text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 10_000  # distinct values of one group


def string_list(df: DataFrame, keys: Sequence[str], value: str, out: str, sep: str = ",", most: int = MOST_VALUES) -> DataFrame:
    """``keys, out``: each group's distinct values, sorted and joined (``STUFF((SELECT DISTINCT ... FOR XML PATH``).

    Repeats go in an aggregate of their own, map-side first, so a group that holds a third of all
    rows reaches one task as its distinct values only; a group with more than ``most`` of them raises.
    NULL values are left out; a group of NULLs alone has the empty text.
    """
    single = df.select(*keys, value).distinct()
    lists = single.groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.expr(f"listagg(`{value}`, '{sep}') WITHIN GROUP (ORDER BY `{value}`)").alias(out))
    told = F.raise_error(F.concat(F.lit(f"more than {most} values of {value} in one group: "), F.col("_n").cast("string")))
    return lists.select(*keys, F.when(F.col("_n") > most, told.cast("string")).otherwise(F.coalesce(out, F.lit(""))).alias(out))
