"""Column expressions shared by the operators. All stay in Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("symbol", "timestamp")


def interval_seconds(interval: str) -> int:
    """Seconds of '5m', '1h', '1d': a positive whole number of minutes, hours or days."""
    found = re.fullmatch(r"\s*([0-9]+)([mhd])\s*", interval)
    if not found or int(found[1]) == 0:
        raise ValueError(f"interval must be a positive number of m, h or d: {interval!r}")
    return int(found[1]) * {"m": 60, "h": 3600, "d": 86400}[found[2]]


def by_time(symbol: str = "symbol", timestamp: str = "timestamp") -> WindowSpec:
    """One window spec for all operators, so Catalyst shares one exchange and one sort."""
    return Window.partitionBy(symbol).orderBy(timestamp)


def clean(value: Column) -> Column:
    """NaN and infinities as null: they would win comparisons."""
    return F.when(F.isnan(value) | value.isin(float("inf"), float("-inf")), None).otherwise(value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def log(value: Column) -> Column:
    """Natural logarithm, null at or below 0."""
    return F.when(value > 0, F.ln(value))


def change(value: Column, w: WindowSpec) -> Column:
    """Relative change to the row before; nulls are not filled."""
    before = F.lag(value).over(w)
    return ratio(value - before, before)


def trailing(value: Column, n: int, how: str, w: WindowSpec, least: int | None = None) -> Column:
    """mean, std, max, min, sum or energy (root of the sum of squares) over the last n rows; null below `least` (n) values."""
    frame = w.rowsBetween(-(n - 1), 0)
    made = {
        "mean": lambda: F.avg(value).over(frame),
        "std": lambda: F.stddev_samp(value).over(frame),
        "max": lambda: F.max(value).over(frame),
        "min": lambda: F.min(value).over(frame),
        "sum": lambda: F.sum(value).over(frame),
        "energy": lambda: F.sqrt(F.sum(value * value).over(frame)),
    }
    if how not in made:
        raise ValueError(f"unknown aggregate {how!r}")
    return F.when(F.count(value).over(frame) >= (n if least is None else least), made[how]())


def leading_sum(value: Column, h: int, w: WindowSpec) -> Column:
    """Sum over the next h rows; null unless all are there."""
    frame = w.rowsBetween(1, h)
    return F.when(F.count(value).over(frame) == h, F.sum(value).over(frame))


def least_periods(n: int, policy: str) -> int:
    if policy not in ("full_window", "allow_partial"):
        raise ValueError(f"unknown policy {policy!r}")
    return n if policy == "full_window" else 1


def severity(psi: Column, warning: float, alert: float) -> Column:
    return F.when(psi.isNull() | F.isnan(psi), "unknown").when(psi >= alert, "alert").when(psi >= warning, "warning").otherwise("ok")
