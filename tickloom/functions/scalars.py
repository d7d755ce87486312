"""Scalar expressions: null-safe arithmetic, ramps, tick grids, session clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.when(b != 0, a / b)


def divide(a: Column, b: Column) -> Column:
    """a / b of doubles as they are: infinite where only b is zero, not a number where both are; null where either is null."""
    return F.when(b == 0, a.cast("double") * float("inf")).otherwise(a / b)


def log(x: Column) -> Column:
    """Natural logarithm of a double, minus infinity at zero."""
    return F.when(x == 0, float("-inf")).otherwise(F.log(x))


def ratio_change(a: Column, b: Column) -> Column:
    return safe_divide(a, b) - 1


def clamp_unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, straight between."""
    return clamp_unit((x - low) / (high - low))


def centred_sigmoid(x: Column) -> Column:
    """2 * logistic(x) - 1."""
    return F.tanh(x / 2)


def to_tick(price: Column, tick: str, how: str) -> Column:
    """A decimal price on a tick grid: `up`, `down` or `even` (half to even)."""
    grid = F.lit(tick).cast("decimal(10,4)")
    steps = (price.cast("decimal(18,4)") / grid).cast("decimal(28,6)")
    rounded = {"up": F.ceil, "down": F.floor, "even": lambda c: F.bround(c, 0)}[how](steps)
    return (rounded.cast("decimal(20,0)") * grid).cast("decimal(18,4)")


def session_of(ts: Column, open_minute: int) -> Column:
    """The session date: times before the open belong to the day before."""
    return F.to_date(ts - F.make_interval(mins=F.lit(open_minute)))


def minutes_since_open(ts: Column, open_minute: int) -> Column:
    """Seconds since the open of the calendar day, in minutes; negative before it."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return seconds / 60 - open_minute
