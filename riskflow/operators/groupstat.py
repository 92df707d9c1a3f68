"""Rows with a statistic of their own group, where one key may hold a large part of all rows.

``agg`` + join sends all rows of a key to one task. The aggregate is no problem (counts merge
map-side); the join back is. So the keys that hold more than ``1 / SPLIT`` of the rows -- fewer
than ``SPLIT`` of them, whatever the data -- are broadcast with their statistics, and their rows
stay where they are; all other rows are joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.operators.materialize import materialize

SPLIT = 1000


def group_statistics(rows: DataFrame, key: Column, stats: dict[str, Column]) -> DataFrame:
    """``_key``, the statistics and the number of rows of every group, written once; a NULL key is no group."""
    return materialize(rows.select(key.alias("_key"), "*").filter("_key is not null").groupBy("_key")
                       .agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in stats.items()]), "group-statistics")


def with_group_statistics(rows: DataFrame, key: Column, found: DataFrame, names: Sequence[str], split: int = SPLIT) -> DataFrame:
    """``rows`` with the columns ``names`` of ``found`` (``group_statistics``), NULL where the key has no group.

    The statistics may stem from more rows than are enriched.
    """
    total = found.agg(F.sum("_rows")).collect()[0][0] or 0
    heavy = F.col("_rows") * split > total
    few = found.filter(heavy).select("_key", *names)                   # less than ``split`` keys
    keyed = rows.select("*", key.alias("_key"))
    # a NULL key meets nothing: its rows stay out of the exchange as well. One condition over both sides of the
    # join, so that nothing is filtered below it and both branches share what ``rows`` shuffles.
    marked = keyed.join(F.broadcast(few.withColumn("_few", F.lit(True))), "_key", "left")
    settled = F.coalesce("_few", F.col("_key").isNull())
    here = marked.filter(settled)
    there = marked.filter(~settled).drop("_few", *names).join(found.filter(~heavy).select("_key", *names), "_key", "left")
    columns = [*rows.columns, *names]
    return here.select(*columns).unionByName(there.select(*columns))
