"""String semantics of the source warehouse.

* ``=`` ignores trailing blanks (``' ' = ''`` is true) -> compare ``rtrim``.
* The collation is case-insensitive -> compare ``lower`` of both sides.
* ``RIGHT('0' + s, 2)`` keeps the last two characters; it is not ``lpad``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """True for '' and all-space strings (NULL stays NULL)."""
    return F.rtrim(_col(c)) == F.lit("")


def not_blank_or(c, default: str) -> Column:
    """``CASE WHEN c <> ' ' THEN c ELSE default END``: NULL and blanks -> default."""
    c = _col(c)
    return F.when(F.rtrim(c) != F.lit(""), c).otherwise(F.lit(default))


def folded(c) -> Column:
    """What the source collation compares: case and trailing blanks do not count."""
    return F.lower(F.rtrim(_col(c)))


def same_text(c, other) -> Column:
    """Equality of a column with a literal (str) or another column under the source collation."""
    right = F.lit(other.rstrip(" ").lower()) if isinstance(other, str) else folded(other)
    return folded(c) == right


def text_in(c, values) -> Column:
    """Membership in a list of literals under the source collation."""
    return folded(c).isin(*[v.rstrip(" ").lower() for v in values])


def pad_right2(c) -> Column:
    """``RIGHT('0' + c, 2)`` (NULL-propagating like ``+``)."""
    return F.right(F.concat(F.lit("0"), _col(c).cast("string")), F.lit(2))
