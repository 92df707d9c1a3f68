"""Top-1 per key, duplicate audit, and the null-aware 'append unseen keys' filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sort_key(df: DataFrame, name: str, desc: bool, nulls_last: bool) -> list[Column]:
    """Ascending-comparable encoding of one ORDER BY item (NULL placement first)."""
    c = F.col(name)
    dtype = df.schema[name].dataType.simpleString()
    parts = [c.isNull() if nulls_last else c.isNotNull()]
    if not desc:
        return parts + [c]
    if dtype == "date":
        return parts + [-F.unix_date(c)]
    if dtype.startswith("timestamp"):
        return parts + [-F.unix_micros(c.cast("timestamp"))]
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or \
            dtype.startswith("decimal"):
        return parts + [-c]
    raise TypeError(f"descending order on {dtype} is not supported by top1_per_key")


def top1_per_key(df: DataFrame, keys: Sequence[str],
                 order: Sequence[tuple[str, str]]) -> DataFrame:
    """Keep the first row per key (``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY ...) = 1``).

    ``order`` is a list of ``(column, 'asc'|'desc')``; ascending puts NULLs first
    and descending puts them last, as the window form does. Make it a total
    order (end with the remaining columns) so the pick is deterministic.

    Written as ``min_by(row, ordering struct)``, an aggregate with map-side
    partial aggregation: a key holding a third of all rows is reduced to one row
    per map task before the shuffle, instead of being sorted in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordering = []
    for name, direction in order:
        desc = direction.lower() == "desc"
        ordering += _sort_key(df, name, desc, nulls_last=desc)
    ord_struct = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(ordering)])
    row = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.min_by(row, ord_struct).alias("_top"))
              .select(*keys, *[F.col("_top")[c].alias(c) for c in rest]))


def rows_with_duplicate_key(df: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs more than once (NULL keys never qualify).

    Written as aggregate + left-semi join rather than a window so that a hot
    key is pre-aggregated map-side and the semi join can be split by AQE skew
    handling.
    """
    dupes = (df.groupBy(key).agg(F.count(key).alias("_n"))
               .filter(F.col("_n") > 1).select(key))
    return df.join(dupes, on=key, how="left_semi")


def not_in_keys(df: DataFrame, key: str, existing: DataFrame, existing_key: str | None = None
                ) -> DataFrame:
    """``WHERE key NOT IN (SELECT existing_key FROM existing)`` with SQL NULL semantics.

    * existing empty -> every row is kept (even a NULL key);
    * existing holds a NULL key -> no row is kept;
    * otherwise rows with a NULL key are dropped, the rest is an anti join.

    The two global conditions come from a one-row summary of ``existing`` (row
    count and whether a NULL key exists), read on the driver -- two numbers, a
    bounded result -- so the rows themselves only meet in a hash anti join on
    the key. (A non-broadcast null-aware anti join in SQL falls back to a
    nested-loop join; a join against the summary is folded into a cross join.)
    """
    ek = existing_key or key
    keys = existing.select(F.col(ek).alias("_k"))
    summary = keys.agg(F.count(F.lit(1)).alias("_n"),
                       F.max(F.col("_k").isNull().cast("int")).alias("_has_null")).first()
    if summary["_n"] == 0:
        return df
    if summary["_has_null"] == 1:
        return df.filter(F.lit(False))
    kept = df.join(keys.filter(F.col("_k").isNotNull()).distinct(),
                   df[key] == F.col("_k"), "left_anti")
    return kept.filter(F.col(key).isNotNull())
