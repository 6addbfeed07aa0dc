"""Scalar column functions: rates, scores, bands, dates, distributions.

All are built-in expressions and stay inside code generation, except the normal
distribution, which Spark has no function for.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GUARD = 1e-9


def clip(x: Column, low: float, high: float) -> Column:
    """x held to low..high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the denominator is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def guarded_change(now: Column, before: Column, guard: float = GUARD) -> Column:
    """(now - before) / max(|before|, guard)."""
    return (now - before) / F.greatest(F.abs(before), F.lit(guard))


def safe_pct_change(before: Column, now: Column) -> Column:
    return F.try_divide(now - before, F.abs(before))


# Percent to ratio. The four rules differ at 1 and above 100 on purpose.
def rate_open(v: Column) -> Column:
    """1 < |v| <= 100 is a percentage."""
    return F.when((F.abs(v) > 1) & (F.abs(v) <= 100), v / 100).otherwise(v)


def rate_closed(v: Column, threshold: float = 1.0, ceiling: float = 500.0) -> Column:
    """threshold <= |v| <= ceiling is a percentage; 1.0 itself becomes 0.01."""
    return F.when((F.abs(v) >= threshold) & (F.abs(v) <= ceiling), v / 100).otherwise(v)


def rate_strict(v: Column) -> Column:
    """1 < |v| <= 100 is a percentage, above 100 is no rate."""
    return F.when(F.abs(v) > 100, F.lit(None).cast("double")).when(F.abs(v) > 1, v / 100).otherwise(v)


def finite(v: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


# Scores.
def zscore(x: Column, mean: Column, std: Column, limit: float = 3.0, guard: float = GUARD) -> Column:
    return clip((x - mean) / F.greatest(std, F.lit(guard)), -limit, limit)


def sigmoid_100(z: Column) -> Column:
    return 100 / (1 + F.exp(-z))


def deviation_pct(x: Column, median: Column, guard: float = GUARD) -> Column:
    return (x - median) / F.greatest(F.abs(median), F.lit(guard)) * 100


def minmax_100(x: Column, low: Column, high: Column) -> Column:
    """50 when all are (nearly) equal."""
    return F.when(F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low)), F.lit(50.0)).otherwise(F.try_divide(x - low, high - low) * 100)


def bands(x: Column, steps: list[tuple[float, str]], last: str, strict: bool = False) -> Column:
    """The label of the first step that x reaches (or exceeds)."""
    out = None
    for at, label in steps:
        test = x > at if strict else x >= at
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(last)


def score_tier(score: Column) -> Column:
    return bands(score, [(80, "top"), (60, "above_average"), (40, "average"), (20, "below_average")], "bottom")


def score_band(score: Column) -> Column:
    return bands(score, [(85, "Market Leader"), (70, "Strong Performer"), (50, "Competitive"), (30, "Underperforming")], "Critical Risk")


def score_position(score: Column) -> Column:
    return bands(score, [(90, "Top 10%"), (75, "Top 25%"), (50, "Top 50%"), (25, "Bottom 50%")], "Bottom 25%")


def band_confidence(score: Column) -> Column:
    """Distance to the nearest edge of the score's band, over half its width."""
    low = F.when(score >= 85, 85).when(score >= 70, 70).when(score >= 50, 50).when(score >= 30, 30).otherwise(0)
    high = F.when(score >= 85, 100).when(score >= 70, 85).when(score >= 50, 70).when(score >= 30, 50).otherwise(30)
    return F.least(score - low, high - score) / ((high - low) / 2)


def log_saturating(n: Column) -> Column:
    return F.when(n > 0, F.ln(n) / F.ln(n + 1)).otherwise(F.lit(0.0))


def vulnerability(score: Column) -> Column:
    """(100 - score) / 100 of a score in 0..100; no score counts as 50."""
    return (100 - clip(F.coalesce(score, F.lit(50.0)), 0.0, 100.0)) / 100


def coefficient_of_variation(std: Column, mean: Column) -> Column:
    return std / F.greatest(F.abs(mean), F.lit(GUARD))


# Real and nominal growth.
def fisher_real(nominal: Column, inflation: Column) -> Column:
    return F.try_divide(1 + nominal, 1 + inflation) - 1


def deflate(level: Column, inflation: Column) -> Column:
    return F.try_divide(level, 1 + inflation)


def is_growth_metric(name: Column) -> Column:
    return F.lower(name).rlike("growth|rate|ratio|margin|churn|pct|percent|retention")


def inflation_adjusted(name: Column, value: Column, inflation: Column) -> Column:
    return F.when(is_growth_metric(name), fisher_real(value, inflation)).otherwise(deflate(value, inflation))


def rate_adjusted_efficiency(real: Column, policy_rate: Column, least: float = -0.95) -> Column:
    return real / (1 + F.greatest(policy_rate, F.lit(least)))


def macro_resilience(nominal: Column, real: Column, sensitivity: float = 1.0) -> Column:
    return clip(100 - F.abs(nominal - real) * sensitivity, 0.0, 100.0)


def shock_multiplier(gdp: Column, rate: Column, sensitivity: Column, w_gdp: float = 0.65, w_rate: float = 0.35, low: float = 0.35, high: float = 1.0) -> Column:
    """What a recession leaves of revenue: contraction and spike are rates or percentages."""
    hit = w_gdp * F.greatest(F.lit(0.0), rate_closed(gdp)) + w_rate * F.greatest(F.lit(0.0), rate_closed(rate))
    return clip(1 - F.greatest(F.lit(0.0), sensitivity) * hit, low, high)


# Dates.
def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def frequency(start: Column, end: Column) -> Column:
    """M or Q if the interval is exactly a calendar month or quarter, else U."""
    return (
        F.when((start == month_start(start)) & (end == F.last_day(start)), "M")
        .when((start == quarter_start(start)) & (end == quarter_end(start)), "Q")
        .otherwise("U")
    )


def month_windows(start: Column, end: Column) -> Column:
    """Starts of the months from start's month to end."""
    return F.sequence(F.to_date(month_start(start)), F.to_date(end), F.expr("interval 1 month"))


def kpi_period_start(earliest: Column, latest: Column, days: int = 90) -> Column:
    return F.greatest(earliest, latest - F.expr(f"interval {days} days"))


def projection_quarter_end(last: Column, k: Column) -> Column:
    return F.last_day(F.add_months(last, k * 3))


# Text.
def traffic_number(raw: Column) -> Column:
    """200K+ is 200000, 1.5M is 1500000; what is no such number is null."""
    text = F.upper(F.regexp_replace(raw, "[,+\\s]", ""))
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 2)
    return number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def normalized_header(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^\p{Alnum}]", "")


def domain(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def is_public_url(url: Column) -> Column:
    """http(s), dotted host, no user part, no private or loopback address."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    private = host.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|^localhost$")
    return F.coalesce(url.rlike("^https?://") & host.contains(".") & ~url.contains("@") & ~private, F.lit(False))


# Distributions.
@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    """Spark has no error function."""
    return x.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))) if v is not None and v == v else None).astype("float64")


def chi_square_survival(x: Column, dof: Column) -> Column:
    """Wilson-Hilferty approximation."""
    spread = 2 / (9 * dof)
    return 1 - norm_cdf((F.cbrt(x / dof) - (1 - spread)) / F.sqrt(spread))


def f_survival(f: Column, df1: Column, df2: Column) -> Column:
    """Cube-root approximation on f * df1 / df2."""
    a, b = 2 / (9 * df1), 2 / (9 * df2)
    r = F.cbrt(f * df1 / df2)
    return 1 - norm_cdf((r * (1 - b) - (1 - a)) / F.sqrt(a + b * r * r))


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided, by the Fisher transform; null for n <= 3, 0 for |r| >= 1."""
    inside = F.when(F.abs(r) < 1, r).otherwise(F.lit(0.0))
    z = 0.5 * F.ln((1 + inside) / (1 - inside)) * F.sqrt(F.greatest(n - 3, F.lit(0)).cast("double"))
    return F.when(n <= 3, F.lit(None)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(2 * (1 - norm_cdf(F.abs(z))))
