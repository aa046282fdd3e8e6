"""Numeric column helpers with the semantics of IEEE doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def is_finite(x: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


def finite(x: Column) -> Column:
    """``x`` where it is finite, else null (so aggregates skip it)."""
    return F.when(is_finite(x), x)


def finite_or(x: Column, other: float = NAN) -> Column:
    """``x`` with ``other`` in place of null, NaN and infinities."""
    return F.when(is_finite(x), x).otherwise(F.lit(float(other)))


def divide(a: Column, b: Column) -> Column:
    """a / b as doubles divide: by zero an infinity or NaN instead of an error."""
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def natural_log(x: Column) -> Column:
    """ln with -Infinity at 0 and NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).when(F.isnan(x), x)


def uint32(x: Column) -> Column:
    """A signed 32-bit number read as unsigned."""
    return F.pmod(x.cast("long"), F.lit(1 << 32))


def int32(x: Column) -> Column:
    """An unsigned 32-bit number read as signed."""
    return F.when(x.cast("long") >= 1 << 31, x.cast("long") - (1 << 32)).otherwise(x.cast("long")).cast("int")


def uint64(x: Column) -> Column:
    """A signed 64-bit number read as unsigned, as decimal(20,0)."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def int64(x: Column) -> Column:
    """An unsigned 64-bit number (decimal) read as signed."""
    d = x.cast("decimal(20,0)")
    return F.when(d >= F.lit(str(1 << 63)).cast("decimal(20,0)"), d - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d).cast("long")


def gamma_of(xmin: Column, xmax: Column, xmid: Column, ymid: Column) -> Column:
    """The display exponent that maps ``xmid`` of the range to ``ymid`` of 255."""
    return F.ln(ymid / 255) / F.ln((xmid - xmin) / (xmax - xmin))
