"""Scalar helpers: rounding, money, time, CASE ladders and predicates from specs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"

# Tax rate by sales region, any other region is untaxed.
TAX_RATES = {"US_EAST": 0.085, "US_WEST": 0.085, "EU": 0.20, "APAC": 0.10}


def col_of(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def half_up(x, digits: int) -> Column:
    """Round half away from zero in plain IEEE steps, so every engine gives the same double.

    From 2^52 scaled units on a double has no fraction left to round and stays as it is.
    """
    scale = 10**digits
    value = col_of(x).cast("double")
    size = F.abs(value) * scale
    return F.when(size < 2.0**52, F.signum(value) * F.floor(size + 0.5) / F.lit(float(scale))).otherwise(value)


def money(x) -> Column:
    return col_of(x).cast(MONEY)


def exact_sum(x, kind: str = MONEY) -> Column:
    """Sum in DECIMAL: independent of partitioning and row order."""
    return F.sum(col_of(x).cast(kind))


def exact_avg(x) -> Column:
    """Average as DECIMAL sum over a double count; null for empty groups."""
    return F.try_divide(F.sum(money(x)).cast("double"), F.count(col_of(x)).cast("double"))


def coalesce_default(x, default) -> Column:
    return F.coalesce(col_of(x), F.lit(default))


def nullif_div(x, y) -> Column:
    """x / y, null where y is 0 (ANSI mode would raise)."""
    return F.try_divide(col_of(x), col_of(y))


def pct(part, whole, digits: int = 2) -> Column:
    """100 * part / whole, rounded half up; null for an empty whole."""
    ratio = F.try_divide(F.lit(100.0) * col_of(part), col_of(whole).cast("double"))
    return half_up(ratio, digits)


def pct_label(value, suffix: str, digits: int = 1) -> Column:
    """'12.3% null' style label."""
    return F.format_string(f"%.{digits}f%% {suffix}", half_up(value, digits))


def as_ts(value) -> Column:
    """Literal instant from a string or datetime."""
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp")


def epoch_ms_time(ms) -> Column:
    return F.timestamp_millis(col_of(ms))


def epoch_ms_date(ms) -> Column:
    return F.to_date(epoch_ms_time(ms))


def epoch_ms_hour(ms) -> Column:
    return F.hour(epoch_ms_time(ms))


def epoch_ms_weekday(ms, monday_first: bool = False) -> Column:
    """1 = Sunday as the order job writes it, or 1 = Monday on request."""
    t = epoch_ms_time(ms)
    return F.weekday(t) + F.lit(1) if monday_first else F.dayofweek(t)


def discount_tier(discount, low: float = 0.10, high: float = 0.20) -> Column:
    """NONE for null or 0, then SMALL below low, MEDIUM up to and including high, else LARGE."""
    d = col_of(discount)
    return (
        F.when(F.coalesce(d, F.lit(0.0)) == 0, "NONE")
        .when(d < low, "SMALL")
        .when(d.between(low, high), "MEDIUM")
        .otherwise("LARGE")
    )


def customer_segment(first_order, lifetime_orders, days_since_last) -> Column:
    return (
        F.when(col_of(first_order), "NEW")
        .when(col_of(lifetime_orders) >= 20, "VIP")
        .when(col_of(days_since_last) > 180, "CHURNED")
        .otherwise("RETURNING")
    )


def tax_rate(region, rates: dict[str, float] | None = None) -> Column:
    """Region to rate as a CASE ladder (a handful of entries, so no join)."""
    ladder = F.lit(0.0)
    for name, rate in reversed(list((rates or TAX_RATES).items())):
        ladder = F.when(col_of(region) == name, F.lit(rate)).otherwise(ladder)
    return ladder


_UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def cutoff_time(spec: str, as_of) -> Column:
    """Start of a relative window: 'last N minute|hour|day', 'today', 'last week',
    'last month', 'this year'. Always relative to an explicit ``as_of``."""
    words = spec.lower().split()
    now = as_ts(as_of)
    if words == ["today"]:
        return F.date_trunc("day", now)
    if words == ["this", "year"]:
        return F.date_trunc("year", now)
    if words == ["last", "week"]:
        return now - F.make_dt_interval(F.lit(7))
    if words == ["last", "month"]:
        return now - F.make_dt_interval(F.lit(30))
    if len(words) == 3 and words[0] == "last" and words[1].isdigit():
        unit = words[2].rstrip("s")
        if unit in _UNIT_SECONDS:
            days, seconds = divmod(int(words[1]) * _UNIT_SECONDS[unit], 86400)
            return now - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(seconds))
    raise ValueError(f"unknown relative time '{spec}'")


def relative_time(column, spec: str, as_of) -> Column:
    """Predicate ``column >= cutoff``; a literal bound, so it reaches the scan."""
    return col_of(column) >= cutoff_time(spec, as_of)


def simple_predicate(column, op: str, value=None) -> Column:
    """'null', 'not null', '>' or '<' on one column; anything else is refused."""
    c = col_of(column)
    if op == "null":
        return c.isNull()
    if op == "not null":
        return c.isNotNull()
    if op == ">":
        return c > value
    if op == "<":
        return c < value
    raise ValueError(f"unsupported predicate '{op}'")


def safe_literal(value) -> Column:
    """A literal of a Python bool, number or string; quoting is Catalyst's business."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return F.lit(value)
    return F.lit(str(value))


def three_level(value, warn, fail) -> Column:
    """pass below warn, warn below fail, else fail."""
    v = col_of(value)
    return F.when(v < warn, "pass").when(v < fail, "warn").otherwise("fail")
