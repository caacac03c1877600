"""Time encodings as native columns, and calendar periods in the unit of a clock."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a day, and the calendar periods in days.
DAY = 86400.0
PERIODS = {"day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
#: Fixed value: raw times that span this much or more are in seconds, others in days.
SECONDS_FROM = 100_000.0


def multiscale_frequencies(dim: int, t_min: float = 1.0, t_max: float = 1.0) -> list[float]:
    """dim / 2 frequencies in geometric series, from one turn in ``t_max`` to one turn in ``t_min``."""
    if dim < 2 or dim % 2:
        raise ValueError("dim must be even and positive")
    shortest = t_min if t_min > 1e-6 else 1e-6
    longest = t_max if t_max > shortest else shortest
    steps = dim // 2
    ratio = (longest / shortest) ** (1 / (steps - 1)) if steps > 1 else 1.0
    return [2 * math.pi / longest * ratio**i for i in range(steps)]


def periodic_frequencies(periods: list[float], harmonics: int = 1) -> list[float]:
    """For each period its frequency and the multiples of it up to ``harmonics``."""
    if harmonics < 1 or not periods:
        raise ValueError("at least one period and one harmonic are needed")
    return [2 * math.pi * h / (p if p > 1e-6 else 1e-6) for p in map(float, periods) for h in range(1, harmonics + 1)]


def encoded(t: Column, frequencies: list[float], prefix: str = "") -> list[Column]:
    """Columns sin_i and cos_i of t times each frequency."""
    return [F.sin(t * f).alias(f"{prefix}sin_{i}") for i, f in enumerate(frequencies)] + [F.cos(t * f).alias(f"{prefix}cos_{i}") for i, f in enumerate(frequencies)]


def days_of_unit(raw_span: float, clock_span: float | None = None) -> float:
    """How many days one unit of a clock is: of the raw clock, or of one on which the raw span is ``clock_span`` units long.

    A clock without a span of its own counts days. Normalised clocks of up to two units are fractions of the whole span.
    """
    raw_unit = 1 / DAY if raw_span >= SECONDS_FROM else 1.0
    if clock_span is None:
        return raw_unit
    if raw_span <= 0 or clock_span <= 0:
        return 1.0
    if raw_span >= SECONDS_FROM:
        return raw_unit * raw_span / clock_span
    return raw_span if clock_span <= 2 else 1.0


def calendar_periods(raw_span: float, clock_span: float | None = None) -> list[float]:
    """A day, a week, a month and a year in units of the clock."""
    unit = days_of_unit(raw_span, clock_span)
    return [days / unit for days in PERIODS.values()]
