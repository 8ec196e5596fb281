"""Arithmetic, probability and time functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Abramowitz-Stegun approximation 7.1.26 of erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, low=0.0, high=1.0) -> Column:
    """x within [low, high]; null stays null (least and greatest alone would skip it)."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def map_range(x, in_low, in_high, out_low, out_high) -> Column:
    return lerp(out_low, out_high, (col(x) - in_low) / (col(in_high) - col(in_low)))


def round_half_up(x, digits: int = 0) -> Column:
    """Halves go towards positive infinity, also for negative numbers."""
    scale = 10.0**digits
    return F.floor(col(x) * scale + 0.5) / scale


def ratio(a, b) -> Column:
    """a / b; null where b is null or 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def change(now, base, scale: float = 100.0) -> Column:
    """Change in percent (or bps with scale 10000); over base 0: 0 if now is 0, else infinite."""
    now, base = col(now), col(base)
    endless = F.when(now == 0, F.lit(0.0)).when(now > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(base == 0, endless).otherwise((now - base) / F.nullif(base, F.lit(0.0)) * scale)


def erf(x) -> Column:
    x = col(x)
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x) -> Column:
    return 0.5 * (1 + erf(col(x) / (2.0**0.5)))


def t_cdf(t, df) -> Column:
    """Student's t by the normal CDF of t / sqrt(1 + t*t/df)."""
    t = col(t)
    return normal_cdf(t / F.sqrt(1 + t * t / col(df)))


def chi2_p_value(x, df) -> Column:
    """Upper tail by Wilson and Hilferty; 1 for x <= 0."""
    df = col(df)
    z = (F.pow(col(x) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return F.when(col(x) <= 0, F.lit(1.0)).otherwise(1 - normal_cdf(z))


def seconds_between(start, end) -> Column:
    """Seconds from start to end as a double."""
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / 1e6


def seconds_to_close(now, close) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(now, close))


def time_ramp(hours) -> Column:
    """Weight that rises to 3 towards the close (never over 5); 1 if the close is unknown."""
    return F.when(col(hours).isNull(), 1.0).otherwise(F.least(F.lit(5.0), 1 + 2 * F.exp(-0.1 * col(hours))))


def time_bucket(minutes) -> Column:
    m = col(minutes)
    out = F.when(m <= 5, "0-5m")
    for low, high in ((5, 15), (15, 30), (30, 60), (60, 120)):
        out = out.when(m <= high, f"{low}-{high}m")
    return out.otherwise("120m+")


def round6(x) -> Column:
    return F.round(col(x).cast("double"), 6)
