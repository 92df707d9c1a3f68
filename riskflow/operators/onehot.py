"""One-hot encoding of a (key, code) relation, packed as bitmasks.

The code list is explicit, or discovered by a bounded pass first (``discover_codes``: the distinct
codes, an error beyond a stated width), so the output schema is fixed before the rows are
read. Each code gets a bit position; the aggregate per key is
a ``bit_or`` of 64-bit masks (one long per 63 codes), so the partial aggregate
and the shuffle carry a couple of longs per key instead of one buffer per code.
Downstream joins can carry the masks (a narrow row that stays under the
whole-stage-codegen field limit) and unpack flags only where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CODES = 2000  # columns of a discovered pivot; more is no one-hot encoding
_BITS = 63  # bits used per long (keeps the sign bit clear)


def mask_columns(n_codes: int, prefix: str = "_w") -> list[str]:
    return [f"{prefix}{w}" for w in range((n_codes + _BITS - 1) // _BITS)]


def discover_codes(pairs: DataFrame, code: str, known: Sequence[str] = (), most: int = MOST_CODES) -> list[str]:
    """The known codes, in their order, and every other code that the data holds, sorted.

    One distinct aggregate, whose result is cut at ``most``: with more codes than that it raises,
    so what reaches the driver is bounded whatever the data. NULL is no code.
    """
    found = [r[0] for r in pairs.select(code).filter(F.col(code).isNotNull()).distinct().limit(most + 1).collect()]
    codes = list(known) + sorted(set(found) - set(known))
    if len(found) > most or len(codes) > most:
        raise ValueError(f"more than {most} codes in {code}: not a column list")
    return codes


def onehot_masks(pairs: DataFrame, key: str, code: str, codes: Sequence[str],
                 count_col: str | None = None, mask_prefix: str = "_w") -> DataFrame:
    """``key, <mask longs>[, count]``: bit i set when the key has ``codes[i]``.

    ``pairs`` must be distinct on (key, code) for ``count_col`` to be the number
    of distinct codes; codes outside ``codes`` set no bit but are counted.
    """
    codes = list(codes)
    code_array = "array(" + ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in codes) + ")"
    # the position is looked up once a row, then read by every mask; -1 when not listed
    pairs = pairs.withColumn("_pos", F.expr(f"array_position({code_array}, `{code}`) - 1"))
    pos = "_pos"
    aggs = []
    for w, name in enumerate(mask_columns(len(codes), mask_prefix)):
        lo = w * _BITS
        bit = (f"CASE WHEN {pos} >= {lo} AND {pos} < {lo + _BITS} "
               f"THEN shiftleft(1L, CAST({pos} - {lo} AS INT)) END")
        aggs.append(F.coalesce(F.expr(f"bit_or({bit})"), F.lit(0).cast("long")).alias(name))
    if count_col:
        aggs.append(F.count(F.col(code)).cast("long").alias(count_col))
    return pairs.groupBy(key).agg(*aggs)


def flag_sql(index: int, polarity: str = "presence", mask_prefix: str = "_w",
             missing: int | None = None) -> str:
    """SQL text of one flag read from the masks.

    ``missing`` is the value when the masks are NULL (the key had no pairs, e.g.
    after a left join); None keeps NULL.
    """
    if polarity not in ("presence", "absence"):
        raise ValueError(polarity)
    w, b = divmod(index, _BITS)
    has = f"CAST(shiftright(`{mask_prefix}{w}`, {b}) & 1L AS INT)"
    expr = has if polarity == "presence" else f"(1 - {has})"
    if missing is not None:
        expr = f"coalesce({expr}, {int(missing)})"
    return expr


def onehot(pairs: DataFrame, key: str, code: str, codes: Sequence[str], prefix: str,
           polarity: str = "presence", count_col: str | None = None) -> DataFrame:
    """Pivot ``(key, code)`` pairs into ``prefix + code`` flag columns.

    polarity='presence': 1 when the key has the code, else 0.
    polarity='absence' : 0 when the key has the code, else 1.
    """
    codes = list(codes)
    g = onehot_masks(pairs, key, code, codes, count_col)
    flags = [f"{flag_sql(i, polarity)} AS `{(prefix + c).replace('`', '``')}`" for i, c in enumerate(codes)]
    rest = [f"`{count_col}`"] if count_col else []
    return g.selectExpr(f"`{key}`", *flags, *rest)
