"""Scalar expressions: missing tokens, parsing, domains, time.

Everything stays in generated code on the JVM.  Raw strings are never cast without a guard, so no
token can raise under ANSI rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.contract import BOOLEANS, MAX_EXACT, MAX_SECONDS, MISSING, Spec

#: Decimal numbers; Spark's own parser also takes suffixes and spellings of NaN.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def missing(c: Column, tokens: tuple[str, ...] = MISSING) -> Column:
    """Null or exactly one of the tokens; nothing is trimmed."""
    return c.isNull() | F.coalesce(c.cast("string").isin(*tokens), F.lit(False))


def number(c: Column, kind: str) -> Column:
    """A double, or null if it isn't a number; kind is the column's Spark type.

    A finite token too large for a double is no number; NaN is missing.
    """
    if kind in ("double", "float"):
        return F.when(~F.isnan(c), c.cast("double"))
    if kind != "string":
        return c.cast("double")
    value = c.try_cast("double")
    return F.when(c.rlike(_NUMBER) & (F.abs(value) < float("inf")), value).when(c.rlike(_INFINITY), F.when(F.ltrim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def infinite(x: Column) -> Column:
    return F.coalesce(F.abs(x) == float("inf"), F.lit(False))


def outside(x: Column, spec: Spec) -> Column:
    """A finite number that its column may not have."""
    bad = F.lit(False)
    if spec.low is not None:
        bad = bad | (x < spec.low)
    if spec.high is not None:
        bad = bad | (x > spec.high)
    if spec.integral:
        bad = bad | (x % 1 != 0)
    if spec.kind == "timestamp":
        bad = bad | (x >= MAX_SECONDS)
    return F.coalesce(bad & ~infinite(x), F.lit(False))


def imprecise(x: Column) -> Column:
    """A whole number that a double can't hold exactly."""
    return F.coalesce((F.abs(x) > MAX_EXACT) & ~infinite(x), F.lit(False))


def code(x: Column) -> Column:
    """The canonical decimal string of a whole number."""
    return x.cast("bigint").cast("string")


def truth(c: Column) -> Column:
    """T or F from the accepted spellings, else null."""
    table = F.create_map(*(F.lit(v) for pair in BOOLEANS.items() for v in pair))
    return F.try_element_at(table, c.cast("string"))


def log1p(x: Column) -> Column:
    """ln(1 + x); nulls pass.  Callers check the domain first."""
    return F.log1p(x)


_UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def timestamp(c: Column, unit: str) -> Column:
    """A UTC timestamp from a number of units since the epoch; invalid values are null."""
    x = c.try_cast("double")
    micros = x / 1000 if unit == "ns" else x * _UNITS[unit]
    return F.timestamp_micros(F.when(F.abs(micros) < 9.0e18, micros).cast("bigint"))


def unit_of(valid_share: float | None, median: float | None) -> str | None:
    """The unit of epoch numbers by their median size; None if under 90 % are numbers."""
    if valid_share is None or valid_share < 0.9 or median is None:
        return None
    return next((u for u, least in (("ns", 1e17), ("us", 1e14), ("ms", 1e11)) if median >= least), "s")


def width_us(freq: str | None) -> int:
    """Microseconds of a bucket width such as 1s, 10ms, 5min, 1h or 1d; 1 for none."""
    if not freq:
        return 1
    m = re.fullmatch(r"(\d*)\s*(us|ms|s|min|h|d|D)", freq)
    if not m or m[1] == "0":
        raise ValueError(f"unknown bucket width {freq!r}")
    size = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}[m[2].lower()]
    return int(m[1] or 1) * size


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket(ts: Column, freq: str | None) -> Column:
    """The start of the timestamp's bucket, in microseconds since the epoch."""
    us, width = micros(ts), width_us(freq)
    return us - F.pmod(us, F.lit(width)) if width > 1 else us


def hour_of(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(-1)).cast("bigint")


def weekday_of(ts: Column) -> Column:
    """Monday is 0; -1 if there is no time."""
    return F.coalesce(F.weekday(ts), F.lit(-1)).cast("bigint")
