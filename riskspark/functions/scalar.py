"""Scalar feature expressions: plain Columns, no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.constants import OTHER_PAYMENT_CODE, PAYMENT_CODES, UNKNOWN_DEVICE

EARTH_KM = 6371.0


def rnd(x: Column, digits: int) -> Column:
    """Half-up rounding in plain IEEE arithmetic, the same on every engine."""
    scale = float(10 ** digits)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def log_amount(amount: Column) -> Column:
    return F.log1p(F.greatest(amount.cast("double"), F.lit(0.0)))


def balance_ratio(amount: Column, balance: Column) -> Column:
    return amount.cast("double") / (F.greatest(balance, F.lit(0.0)) + F.lit(1e-5))


def hour_of(us: Column) -> Column:
    return F.floor(F.pmod(us, F.lit(86_400_000_000)) / F.lit(3_600_000_000)).cast("int")


def weekday_of(us: Column) -> Column:
    """Monday is 0; the epoch was a Thursday."""
    return F.pmod(F.floor(us / F.lit(86_400_000_000)) + F.lit(3), F.lit(7)).cast("int")


def given(df: DataFrame, name: str, derived: Column) -> Column:
    """The row's own whole-number value where the table has one, else the derived value."""
    return F.coalesce(F.col(name).cast("int"), derived) if name in df.columns else derived


def is_weekend(weekday: Column) -> Column:
    return (weekday >= 5).cast("int")


def is_night(hour: Column) -> Column:
    return ((hour < 6) | (hour > 22)).cast("int")


def hour_sin(hour: Column) -> Column:
    return rnd(F.sin(hour * F.lit(2.0 * math.pi) / F.lit(24.0)), 5)


def hour_cos(hour: Column) -> Column:
    return rnd(F.cos(hour * F.lit(2.0 * math.pi) / F.lit(24.0)), 5)


def payment_code(payment_type: Column) -> Column:
    pairs = [F.lit(x) for item in PAYMENT_CODES.items() for x in item]
    code = F.try_element_at(F.create_map(*pairs), F.upper(payment_type))
    return F.coalesce(code, F.lit(OTHER_PAYMENT_CODE))


def has_place(lat: Column, lon: Column) -> Column:
    return (lat != 0.0) | (lon != 0.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; an end at (0, 0) means the place is not known."""
    half = F.lit(2.0)
    a = F.pow(F.sin(F.radians(lat2 - lat1) / half), 2) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
        * F.pow(F.sin(F.radians(lon2 - lon1) / half), 2)
    )
    km = F.lit(2.0 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))
    return F.when(has_place(lat1, lon1) & has_place(lat2, lon2), km).otherwise(0.0)


def speed_kmh(km: Column, seconds: Column) -> Column:
    hours = F.greatest(seconds / F.lit(3600.0), F.lit(1.0 / 3600.0))
    return F.when((km > 0) & (seconds > 0), km / hours).otherwise(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def zscore(amount: Column, n: Column, mean: Column, std: Column) -> Column:
    """Unrounded deviation; one prior row is scaled by half its amount instead of a spread."""
    single = (amount - mean) / F.greatest(mean * 0.5, F.lit(1.0))
    many = (amount - mean) / F.greatest(std, F.lit(1e-4))
    return (F.when(n == 0, F.lit(0.0)).when(n == 1, clip(single, -5.0, 10.0))
            .otherwise(clip(many, -5.0, 10.0)))


def hour_deviation(hour: Column, n: Column, hour_sum: Column) -> Column:
    gap = F.abs(hour - hour_sum.cast("double") / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(gap, F.lit(24.0) - gap))


def sample_std(n: Column, total: Column, squares: Column) -> Column:
    """ddof 1 from exact moments; one cast to double at the end."""
    wide = "decimal(38,0)"
    spread = (n.cast("decimal(12,0)") * squares - total.cast("decimal(19,0)") * total.cast("decimal(19,0)"))
    var = spread.cast(wide).cast("double") / (n * (n - 1)).cast("double")
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))


def known_device(device: Column) -> Column:
    name = F.trim(device)
    return F.coalesce((name != "") & (name != UNKNOWN_DEVICE), F.lit(False))


def rule_count(amount: Column, balance: Column, auth: Column, speed: Column, n_1m: Column) -> Column:
    amount = amount.cast("double")
    unverified = auth == 0
    checks = [
        (balance == 0) & (amount > 5000) & unverified,
        (balance > 0) & (amount / (balance + F.lit(1e-5)) > 0.90),
        speed > 800,
        n_1m >= 3,
        unverified & (amount > 2500),
    ]
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks[1:]),
               F.coalesce(checks[0], F.lit(False)).cast("int"))
