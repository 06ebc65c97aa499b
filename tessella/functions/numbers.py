"""Rounding, percentiles, rates and durations, with the conventions that the reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity: -2.5 to -2, 2.5 to 3. round() and bround() do otherwise."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def rate(part: Column, whole: Column, digits: int | None = None, empty: float | None = 0.0) -> Column:
    """part / whole; `empty` (0 or null, reports differ) where whole is 0 or null."""
    value = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    value = value if digits is None else half_up(value, digits)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def pct(part: Column, whole: Column, digits: int | None = None, empty: float | None = 0.0) -> Column:
    return rate(part * F.lit(100.0), whole, digits, empty)


def nearest_rank(name: str, p: float) -> Column:
    """The value at place ceil(p * n) of the sorted ones: an element, never a mean of two."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)")


def upper_median(name: str) -> Column:
    """The element at floor(n / 2) of the sorted values, from 0: of two middle ones the upper."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def truthy(c: Column) -> Column:
    """Neither null nor 0."""
    return c.isNotNull() & (c != 0)


def hours(ms: Column) -> Column:
    return ms.cast("double") / 3_600_000.0


def duration_text(ms: Column) -> Column:
    """1h 2m, 3m 4s or 5s."""
    s = F.floor(ms / 1000)
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    text = F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
    text = text.when(m > 0, F.concat(m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    return text.otherwise(F.concat(s.cast("string"), F.lit("s")))
