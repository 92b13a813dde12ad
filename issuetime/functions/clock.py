"""Scalar clock and level functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuetime.schemas import DAY, HOUR, MINUTE


def local_fields(us: Column, offset: int = 8 * HOUR) -> list[Column]:
    """hour, minute (of the day), day, weekday (0 Monday), weekend on the fixed local clock."""
    t = us + offset
    part, day = F.pmod(t, F.lit(DAY)), (t - F.pmod(t, F.lit(DAY))) / DAY
    weekday = F.pmod(day.cast("long") + 3, F.lit(7))
    return [F.floor(part / HOUR).alias("hour"), F.floor(part / MINUTE).alias("minute"), day.cast("long").alias("day"), weekday.alias("weekday"), (weekday >= 5).alias("weekend")]


def cyclic(us: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.pmod(us, F.lit(period)) / period
    return F.sin(angle), F.cos(angle)


def next_session_start(us: Column, hours: tuple[int, ...], lead: int) -> Column:
    """The first session start (hours of the UTC day, today or tomorrow) at least ``lead`` ahead."""
    day = us - F.pmod(us, F.lit(DAY))
    starts = F.array(*(day + (h + 24 * d) * HOUR for d in (0, 1, 2) for h in hours))
    return F.array_min(F.filter(starts, lambda x: x >= us + lead))


def corrected(level: Column, humidity: Column) -> Column:
    """Humidity-corrected level below 210 by published coefficients, blended between 30 and 50."""
    # Fixed values of the published correction.
    low, high, wet, base = 0.524, 0.786, 0.0862, 5.75
    share = level / 20 - 1.5
    slope = F.when(level < 30, F.lit(low)).when(level < 50, high * share + low * (1 - share)).otherwise(F.lit(high))
    return slope * level - wet * humidity + base


def corrected_everywhere(level: Column, humidity: Column) -> Column:
    """:func:`corrected` with the blend from 210 to 260 and the curve above; the raw level without finite humidity; never below 0."""
    share = level / 50 - 21 / 5
    blend = (0.69 * share + 0.786 * (1 - share)) * level - 0.0862 * humidity * (1 - share) + 2.966 * share + 5.75 * (1 - share)
    full = F.when(level < 210, corrected(level, humidity)).when(level < 260, blend).otherwise(2.966 + 0.69 * level + 8.84e-4 * level * level)
    dry = humidity.isNull() | F.isnan(humidity) | (F.abs(humidity) == float("inf"))
    value = F.when(level == 0, F.lit(0.0)).when(dry, level).otherwise(full)
    return F.when(level.isNotNull() & ~F.isnan(level), F.greatest(value, F.lit(0.0)))
