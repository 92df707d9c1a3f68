"""Binning from small specs, compiled to one ``CASE WHEN`` chain (stays in codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Bound = float | int | None


def range_bins(value: Column, bins: Sequence[tuple[Bound, Bound, object]], default=None
               ) -> Column:
    """``lo <= value <= hi -> label`` in order; ``None`` bounds are open ends.

    ``default`` is the ELSE label (NULL when None, as a CASE without ELSE).
    """
    out = None
    for lo, hi, label in bins:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (value >= lo)
        if hi is not None:
            cond = cond & (value <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def capped_levels(value: Column, levels: Sequence[int], cap: int, null_level=None,
                  default=None) -> Column:
    """Equality bins with a cap: each listed level maps to itself, ``>= cap`` to cap."""
    out = F.when(value.isNull(), F.lit(null_level)) if null_level is not None else None
    for lv in levels:
        cond = value == lv
        out = F.when(cond, F.lit(lv)) if out is None else out.when(cond, F.lit(lv))
    out = out.when(value >= cap, F.lit(cap))
    return out.otherwise(F.lit(default)) if default is not None else out
