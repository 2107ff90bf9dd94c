"""Missing-value rules.

Sources turn NaN, infinities and sentinels into NULL once; everything after relies on
SQL NULL semantics. `least`/`greatest` skip NULL, so they are used on guarded input only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities (NaN sorts above infinity, so one comparison does it)."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def sentinel_to_null(value: Column, sentinel: float | None) -> Column:
    """NULL for the nodata marker, for NaN and for infinities."""
    value = finite(value)
    return value if sentinel is None else F.nullif(value, F.lit(float(sentinel)))


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Limit to [low, high]; NULL stays NULL. Bounds are non-null.

    The guard keeps `greatest` and `least` from skipping a NULL value; unlike a chain of
    comparisons it writes `value` out only twice.
    """
    return F.when(value.isNotNull(), F.least(F.greatest(value, _column(low)), _column(high)))


def at_most(value: Column, high: Column | float) -> Column:
    high = _column(high)
    return F.when(value > high, high).otherwise(value)


def keep_between(value: Column, low: float, high: float) -> Column:
    """NULL outside [low, high]."""
    return F.when(value.between(low, high), value)


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
