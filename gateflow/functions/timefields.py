"""Column expressions over event times, slots and days. No Python UDF anywhere."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gateflow.constants import BANDS_X, BANDS_Y, DEFAULT_BAND, SLOT_MINUTES

_MONDAY = dt.date(1970, 1, 5)


def parse_time(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Naive local time from text."""
    return F.to_timestamp_ntz(text, F.lit(fmt))


def midnight(day: dt.date) -> Column:
    """Start of a day as a naive time literal, independent of any time zone."""
    return F.expr(f"TIMESTAMP_NTZ'{day.isoformat()} 00:00:00'")


def slot_in_hour(ts: Column, minutes: int = SLOT_MINUTES, offset: int = 0) -> Column:
    """Slot within the hour; ``offset`` minutes shift the phase (the last one may be 6)."""
    return F.floor((F.minute(ts) + F.lit(offset)) / F.lit(minutes)).cast("int")


def slot_in_day(ts: Column, minutes: int = SLOT_MINUTES, offset: int = 0) -> Column:
    """Slot within the day, 0-143 for ten minutes."""
    return (F.hour(ts) * F.lit(60 // minutes) + slot_in_hour(ts, minutes, offset)).cast("int")


def slot_start(day: Column, slot: Column, minutes: int = SLOT_MINUTES) -> Column:
    """Naive start time of a slot."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), slot * F.lit(minutes))


def slot_end(day: Column, slot: Column, minutes: int = SLOT_MINUTES) -> Column:
    return slot_start(day, slot + F.lit(1), minutes)


def floor_time(ts: Column, minutes: int = SLOT_MINUTES) -> Column:
    """Event time floored to the start of its slot."""
    return slot_start(F.to_date(ts), slot_in_day(ts, minutes), minutes)


def hour_of(slot: Column, minutes: int = SLOT_MINUTES) -> Column:
    return F.floor(slot / F.lit(60 // minutes)).cast("int")


def minute_of(slot: Column, minutes: int = SLOT_MINUTES) -> Column:
    """Minute within the hour at which the slot starts."""
    return ((slot % F.lit(60 // minutes)) * F.lit(minutes)).cast("int")


def minute_of_day(hour: Column, minute: Column) -> Column:
    return (hour * F.lit(60) + minute).cast("int")


def weekday(day: Column, first: int = 0) -> Column:
    """Monday is ``first``: 0 by default, 1 for the other convention in use."""
    return (F.weekday(day) + F.lit(first)).cast("int")


def weekend_flag(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def service_band(hour: Column, variant: str = "X") -> Column:
    """Service-period code of an hour."""
    bands = {"X": BANDS_X, "Y": BANDS_Y}[variant]
    out = F.lit(DEFAULT_BAND)
    for code, ranges in bands.items():
        hit = F.lit(False)
        for low, high in ranges:
            hit = hit | hour.between(low, high)
        out = F.when(hit, F.lit(code)).otherwise(out)
    return out.cast("int")


def rebase(ts: Column, days: int) -> Column:
    """Copy an event time onto another date."""
    return ts + F.make_dt_interval(F.lit(days))


def is_business_day(day: Column, holidays: Sequence[dt.date] = ()) -> Column:
    open_day = F.weekday(day) < 5
    return open_day & ~day.isin(list(holidays)) if holidays else open_day


def business_index(day: Column, holidays: Sequence[dt.date] = (), origin: dt.date | None = None) -> Column:
    """Consecutive integer per business day, NULL on other days.

    Pure arithmetic (whole weeks times five, plus the weekday, minus the holidays so far): a fact
    row gets its index without a calendar join or a global window. ``origin`` becomes 1.
    """
    def count_up_to(d: Column) -> Column:
        weeks = F.floor(F.datediff(d, F.lit(_MONDAY)) / F.lit(7)) * F.lit(5)
        raw = weeks + F.least(F.weekday(d), F.lit(4)) + F.lit(1)
        closed = [h for h in holidays if h.weekday() < 5]
        if closed:
            raw = raw - F.size(F.filter(F.array(*[F.lit(h) for h in closed]), lambda h: h <= d))
        return raw

    index = count_up_to(day)
    if origin is not None:
        index = index - count_up_to(F.lit(origin)) + F.lit(1)
    return F.when(is_business_day(day, holidays), index.cast("int"))


def days_since_first(day: Column, first: Column) -> Column:
    return F.datediff(day, first).cast("int")


def add_time_fields(df, day: str = "day", slot: str = "slot"):
    """Weekday, weekend flag, hour and minute for rows keyed by day and slot."""
    return df.withColumns({
        "weekday": weekday(F.col(day)),
        "hour": hour_of(F.col(slot)),
        "minute": minute_of(F.col(slot)),
    })
