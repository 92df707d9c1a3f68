"""Numeric helpers: guarded ratios, clamps that keep NULLs, logistic, distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in miles used by the source distance formula.
EARTH_RADIUS_MILES = 3949.99


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num, den) -> Column:
    """``num / NULLIF(den, 0)`` as a double; NULL instead of a divide-by-zero error."""
    return _col(num).cast("double") / F.nullif(_col(den).cast("double"), F.lit(0.0))


def floor_zero(c) -> Column:
    """``CASE WHEN c < 0 THEN 0 ELSE c END``; NULL stays NULL (``greatest`` would not)."""
    c = _col(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)


def clamp_upper(c, hi) -> Column:
    """``CASE WHEN c > hi THEN hi ELSE c END``; NULL stays NULL."""
    c = _col(c)
    return F.when(c > hi, F.lit(hi)).otherwise(c)


def logistic(linear) -> Column:
    """``exp(x) / (1 + exp(x))`` written as ``1 / (1 + exp(-x))`` (no overflow to NaN)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(linear)))


def great_circle_miles(lat1, lon1, lat2, lon2) -> Column:
    """Spherical law of cosines in miles.

    The cosine is clamped to [-1, 1] on both sides so rounding never yields NaN;
    a NULL coordinate gives a NULL distance (no ``least``/``greatest``, which skip NULLs).
    """
    la1, la2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dlon = F.radians(_col(lon2)) - F.radians(_col(lon1))
    cosv = F.sin(la1) * F.sin(la2) + F.cos(la1) * F.cos(la2) * F.cos(dlon)
    cosv = F.when(cosv > 1.0, F.lit(1.0)).when(cosv < -1.0, F.lit(-1.0)).otherwise(cosv)
    return F.lit(EARTH_RADIUS_MILES) * F.acos(cosv)
