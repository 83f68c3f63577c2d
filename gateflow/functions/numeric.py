"""Numeric and categorical column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateflow.constants import LINE_CODES


def log_feature(x: Column) -> Column:
    """1 + log2(x); zero flow (no logarithm) becomes 0."""
    return F.coalesce(F.lit(1.0) + F.log2(F.when(x > 0, x)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(x: Column) -> Column:
    """Absolute value of the forecast rounded half to even."""
    return F.abs(F.rint(x))


def truncate(x: Column) -> Column:
    return x.cast("int")


def clip(x: Column, low: float | None = 0.0, high: float | None = None) -> Column:
    out = x
    if high is not None:
        out = F.least(F.lit(high), out)
    if low is not None:
        out = F.greatest(F.lit(low), out)
    return F.when(x.isNotNull(), out)


def equal_width_code(x: Column, low: Column, high: Column, bins: int = 5) -> Column:
    """Right-closed equal-width bin, 0-based; the lowest value falls into bin 0."""
    position = F.try_divide((x - low).cast("double") * F.lit(bins), (high - low).cast("double"))
    return F.greatest(F.lit(0), F.ceil(position) - F.lit(1)).cast("int")


def line_code(line: Column) -> Column:
    """Numeric code of a line letter, NULL when unknown."""
    out = F.lit(None).cast("int")
    for letter, code in LINE_CODES.items():
        out = F.when(line == letter, F.lit(code)).otherwise(out)
    return out


def comfort_index(temp: Column, wind: float = 2.0, humidity: float = 0.6) -> Column:
    """Comfort score from temperature, wind speed and relative humidity."""
    # Coefficients of the published comfort formula.
    warmth = (F.lit(1.818) * temp + F.lit(18.18)) * F.lit(0.88 + 0.002 * humidity)
    heat = F.try_divide(temp - F.lit(32.0), F.lit(45.0) - temp)
    return warmth + heat - F.lit(3.2 * wind) + F.lit(18.2)


def time_rank(station: Column, day_number: Column, hour: Column, minute: Column) -> Column:
    """Composite rank of station and time."""
    return (station + F.lit(1)) * (day_number * F.lit(144) + hour * F.lit(6) + minute)
