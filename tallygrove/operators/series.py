"""Statistical operators over ordered series (keys, seq, value).

Aggregates and windows wherever they express the operator; folds are
higher-order functions over one series' own values; binary segmentation,
Granger tests and seasonal smoothing are grouped-map functions, one series (a
few hundred points) at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, chi_square_survival, clip, correlation_p_value
from tallygrove.operators.windows import KEYS, along, latest, period_growth, whole


# Trend.
def ols(df: DataFrame, keys=KEYS) -> DataFrame:
    """Per series: n, mean, slope, intercept, r_squared, residual_std of value on seq."""
    fit = df.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.regr_slope("value", "seq").alias("__s"),
        F.regr_intercept("value", "seq").alias("__i"),
        F.var_pop("value").alias("__vy"),
        F.var_pop("seq").alias("__vx"),
        F.max_by("value", "seq").alias("last"),
        F.max("seq").alias("last_seq"),
    )
    slope = F.when(F.col("__vx") * F.col("n") < GUARD, F.lit(0.0)).otherwise(F.coalesce("__s", F.lit(0.0)))
    explained = slope * slope * F.col("__vx")
    r2 = F.greatest(F.lit(0.0), 1 - (F.col("__vy") - explained) / F.greatest(F.col("__vy"), F.lit(GUARD)))
    spread = F.sqrt(F.greatest(F.col("__vy") - explained, F.lit(0.0)) * F.col("n") / F.greatest(F.col("n") - 2, F.lit(1)))
    return fit.select(
        *keys, "n", "mean", slope.alias("slope"), F.coalesce("__i", "mean").alias("intercept"),
        F.when(F.col("__vy") < GUARD, F.lit(0.0)).otherwise(r2).alias("r_squared"),
        F.when(F.col("n") > 2, spread).otherwise(F.lit(0.0)).alias("residual_std"), "last", "last_seq",
    )


def trend_label(slope: Column, mean: Column) -> Column:
    share = F.when(mean == 0, slope).otherwise(F.try_divide(slope, F.abs(mean)))
    return F.when(share > 0.05, "strong_uptrend").when(share > 0.01, "uptrend").when(share < -0.05, "strong_downtrend").when(share < -0.01, "downtrend").otherwise("stable")


def trend_label_gated(slope: Column, mean: Column, r_squared: Column) -> Column:
    return F.when(r_squared < 0.3, "inconclusive").otherwise(trend_label(slope, mean))


def linear_forecast(df: DataFrame, keys=KEYS, horizon: int = 3) -> DataFrame:
    """A row per series and step: last + step x slope, and the last value's deviation from the fitted line."""
    fit = ols(df, keys)
    fitted = F.col("slope") * F.col("last_seq") + F.col("intercept")
    out = fit.withColumn("deviation", (F.col("last") - fitted) / F.greatest(F.abs(fitted), F.lit(GUARD)))
    return out.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, "step", (F.col("last") + F.col("step") * F.col("slope")).alias("forecast"), "deviation", "slope", "r_squared"
    )


def line_forecast(df: DataFrame, keys=KEYS, horizon: int = 3) -> DataFrame:
    """The fitted line carried on; confidence 0.7 r_squared + 0.3 min(n / 12, 1)."""
    fit = ols(df, keys).withColumn("confidence", clip(0.7 * F.col("r_squared") + 0.3 * F.least(F.col("n") / 12, F.lit(1.0)), 0.0, 1.0))
    return fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, "step", (F.col("intercept") + F.col("slope") * (F.col("last_seq") + F.col("step"))).alias("forecast"), "confidence"
    )


def drift_forecast(df: DataFrame, keys=KEYS, horizon: int = 3) -> DataFrame:
    """last + step x mean change; for short series."""
    steps = df.withColumn("__d", F.col("value") - F.lag("value").over(along(keys)))
    ends = steps.groupBy(*keys).agg(F.max_by("value", "seq").alias("last"), F.coalesce(F.avg("__d"), F.lit(0.0)).alias("drift"), F.count("value").alias("n"))
    return ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *keys, "step", (F.col("last") + F.col("step") * F.col("drift")).alias("forecast"), F.least(F.lit(0.4), 0.1 * F.col("n")).alias("confidence")
    )


def rolling_forecast(df: DataFrame, keys=KEYS, horizon: int = 3, width: int = 3) -> DataFrame:
    """The last rolling mean, for every step."""
    mean = F.avg("value").over(along(keys).rowsBetween(-(width - 1), 0))
    last = latest(df.withColumn("forecast", mean), keys)
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(*keys, "step", "forecast")


def forecast_confidence(n: Column, r_squared: Column, cv: Column, tier: Column) -> Column:
    """depth x fit x stability, capped by tier and by a fit below 0.1."""
    depth = F.when(n <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.ln(F.greatest(n, F.lit(1)).cast("double")) / F.ln(F.lit(12.0))))
    stability = F.greatest(F.lit(0.3), 1 - F.least(F.lit(0.7), cv / 2))
    cap = F.when(tier == "minimal", 0.4).when(tier == "standard", 0.8).otherwise(1.0)
    cap = F.when(r_squared < 0.1, F.least(cap, F.lit(0.15))).otherwise(cap)
    return F.greatest(F.lit(0.0), F.least(cap, depth * F.coalesce(r_squared, F.lit(1.0)) * stability))


def tiered_forecast(df: DataFrame, keys=KEYS) -> DataFrame:
    """Per series: tier by depth, model, confidence, trend and next value (rolling mean or line)."""
    fit = ols(df, keys)
    spread = df.groupBy(*keys).agg(F.stddev_pop("value").alias("__sd"))
    roll = rolling_forecast(df, keys, 1).select(*keys, F.col("forecast").alias("__roll"))
    out = fit.join(spread, list(keys)).join(roll, list(keys))
    n = F.col("n")
    tier = F.when(n < 3, "insufficient").when(n < 6, "minimal").when(n < 12, "standard").otherwise("robust")
    cv = F.col("__sd") / F.greatest(F.abs(F.col("mean")), F.lit(GUARD))
    fits = F.when(n >= 6, F.col("r_squared"))
    return out.withColumn("tier", tier).select(
        *keys,
        "n",
        "tier",
        F.when(n < 3, "none").when(n < 6, "rolling_average").otherwise("ols_regression").alias("model"),
        F.when(n < 3, F.lit(0.0)).otherwise(forecast_confidence(n, fits, cv, F.col("tier"))).alias("confidence"),
        F.when(n < 6, "inconclusive").otherwise(trend_label_gated(F.col("slope"), F.col("mean"), F.col("r_squared"))).alias("trend"),
        F.when(n < 3, F.lit(None)).when(n < 6, F.col("__roll")).otherwise(F.col("last") + F.col("slope")).alias("next_value"),
    )


def detrended(df: DataFrame, keys=KEYS, name: str = "residual") -> DataFrame:
    """value less its fitted line."""
    w = whole(keys)
    slope = F.coalesce(F.regr_slope("value", "seq").over(w), F.lit(0.0))
    mean_x, mean_y = F.avg("seq").over(w), F.avg("value").over(w)
    return df.withColumn(name, F.col("value") - (mean_y + slope * (F.col("seq") - mean_x)))


# Residuals.
def durbin_watson(df: DataFrame, residual: str = "residual", keys=KEYS) -> DataFrame:
    step = df.withColumn("__d", F.col(residual) - F.lag(residual).over(along(keys)))
    total = step.groupBy(*keys).agg(F.sum(F.col("__d") * F.col("__d")).alias("__n"), F.sum(F.col(residual) * F.col(residual)).alias("__m"))
    return total.select(*keys, F.when(F.col("__m") > 1e-12, F.try_divide("__n", "__m")).alias("durbin_watson"))


def autocorrelation(df: DataFrame, lags: list[int], value: str = "value", keys=KEYS) -> DataFrame:
    """A row per series and lag: biased autocorrelation (0 for a constant series)."""
    centred = df.withColumn("__c", F.col(value) - F.avg(value).over(whole(keys)))
    shifted = centred.withColumns({f"__p{k}": F.col("__c") * F.lag("__c", k).over(along(keys)) for k in lags})
    sums = shifted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__c") * F.col("__c")).alias("__v"), *(F.sum(f"__p{k}").alias(f"__p{k}") for k in lags))
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"__p{k}").alias("p")) for k in lags))
    flat = sums.select(*keys, "n", "__v", F.inline(pairs))
    acf = F.when(F.col("__v") <= GUARD, F.lit(0.0)).otherwise(F.try_divide(F.coalesce("p", F.lit(0.0)), "__v"))
    return flat.select(*keys, "n", "lag", acf.alias("acf"))


def ljung_box(df: DataFrame, residual: str = "residual", keys=KEYS, max_lag: int = 10) -> DataFrame:
    """Q over lags up to min(max_lag, n / 3) and its p-value; null below 8 points."""
    acf = autocorrelation(df, list(range(1, max_lag + 1)), residual, keys).where(F.col("lag") <= F.floor(F.col("n") / 3))
    q = acf.groupBy(*keys, "n").agg(F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("__q"), F.max("lag").alias("lags"))
    q = q.withColumn("q", F.when(F.col("n") >= 8, F.col("n") * (F.col("n") + 2) * F.col("__q")))
    return q.select(*keys, "lags", "q", chi_square_survival(F.col("q"), F.col("lags")).alias("p_value"))


# Anomalies.
def iqr_bounds(df: DataFrame, keys=KEYS, multiplier: float = 1.5) -> DataFrame:
    """Per series: q1, q3 (linear), lower and upper; null with fewer than two points."""
    m = max(0.5, multiplier)
    q = df.groupBy(*keys).agg(F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"), F.count("value").alias("n")).where("n >= 2")
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "q1", "q3", (F.col("q1") - m * iqr).alias("lower"), (F.col("q3") + m * iqr).alias("upper"))


def anomaly_flags(df: DataFrame, keys=KEYS, iqr: float = 1.5, mad: float = 3.5, z: float = 2.5) -> DataFrame:
    """Adds is_iqr, is_mad and is_z: outside the quartile fences, the median-deviation score, the z-score."""
    w = whole(keys)
    q1, q3 = (F.percentile("value", F.lit(p)).over(w) for p in (0.25, 0.75))
    marked = df.withColumns({"__q1": q1, "__q3": q3, "__med": F.percentile("value", F.lit(0.5)).over(w), "__m": F.avg("value").over(w), "__s": F.stddev_pop("value").over(w), "__n": F.count("value").over(w)})
    marked = marked.withColumn("__mad", F.percentile(F.abs(F.col("value") - F.col("__med")), F.lit(0.5)).over(w))
    width = iqr * (F.col("__q3") - F.col("__q1"))
    return marked.withColumns(
        {
            "is_iqr": (F.col("value") < F.col("__q1") - width) | (F.col("value") > F.col("__q3") + width),
            "is_mad": F.abs(0.6745 * (F.col("value") - F.col("__med")) / F.greatest(F.col("__mad"), F.lit(GUARD))) >= mad,
            "is_z": (F.col("__n") >= 5) & (F.abs((F.col("value") - F.col("__m")) / F.greatest(F.col("__s"), F.lit(GUARD))) >= z),
        }
    ).drop("__q1", "__q3", "__med", "__mad", "__m", "__s", "__n")


def phase_residual_flags(df: DataFrame, period: int, keys=KEYS, z: float = 2.5) -> DataFrame:
    """Adds is_seasonal: far from the mean of its own phase."""
    phased = df.withColumn("__ph", F.col("seq") % period)
    own = F.avg("value").over(Window.partitionBy(*keys, "__ph"))
    out = phased.withColumn("__r", F.col("value") - own)
    spread = F.stddev_pop("__r").over(whole(keys))
    return out.withColumn("is_seasonal", F.abs(F.col("__r") / F.greatest(spread, F.lit(GUARD))) >= z).drop("__r", "__ph")


def packed(df: DataFrame, keys=KEYS) -> DataFrame:
    """Per series: xs, its values in order."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("xs"))


def cusum_shifts(df: DataFrame, keys=KEYS, sigmas: float = 4.0) -> DataFrame:
    """Per series: indexes at which the running sum of deviations reaches `sigmas` deviations; the sum then starts again."""
    stats = packed(df, keys).join(df.groupBy(*keys).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s")), list(keys))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("hits"), F.lit(1).alias("i"))
    limit, mean = sigmas * F.col("__s"), F.col("__m")

    def step(acc: Column, x: Column) -> Column:
        s = acc["s"] + x - mean
        hit = F.abs(s) >= limit
        return F.struct(
            F.when(hit, F.lit(0.0)).otherwise(s).alias("s"),
            F.when(hit, F.concat(acc["hits"], F.array(acc["i"]))).otherwise(acc["hits"]).alias("hits"),
            (acc["i"] + 1).alias("i"),
        )

    hits = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), start, step, lambda a: a["hits"])
    enough = (F.size("xs") >= 8) & (F.col("__s") > GUARD)
    return stats.select(*keys, F.when(enough, hits).otherwise(F.array().cast("array<int>")).alias("shifts"))


def two_sided_cusum(df: DataFrame, keys=KEYS, sigmas: float = 4.0, apart: int = 4, most: int = 5) -> DataFrame:
    """Per series: change points of separate upward and downward sums from the second value on, at least `apart` apart, at most `most`."""
    stats = packed(df, keys).join(df.groupBy(*keys).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s")), list(keys))
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<int>").alias("hits"), F.lit(1).alias("i"))
    limit = sigmas * F.col("__s")

    def step(acc: Column, x: Column) -> Column:
        up = F.greatest(F.lit(0.0), acc["up"] + x - F.col("__m"))
        down = F.least(F.lit(0.0), acc["down"] + x - F.col("__m"))
        hit = (up > limit) | (down < -limit)
        return F.struct(
            F.when(hit, F.lit(0.0)).otherwise(up).alias("up"),
            F.when(hit, F.lit(0.0)).otherwise(down).alias("down"),
            F.when(hit, F.concat(acc["hits"], F.array(acc["i"]))).otherwise(acc["hits"]).alias("hits"),
            (acc["i"] + 1).alias("i"),
        )

    hits = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), start, step, lambda a: a["hits"])
    found = F.when((F.col("__s") > GUARD) & (F.size("xs") >= 2 * apart), hits).otherwise(F.array().cast("array<int>"))
    return stats.select(*keys, F.slice(merge_nearby(found, apart), 1, most).alias("changepoints"))


def merge_nearby(indexes: Column, apart: int) -> Column:
    """Of ascending indexes, those at least `apart` after the last one kept."""
    none = F.array().cast("array<int>")
    return F.aggregate(
        F.array_sort(indexes),
        none,
        lambda kept, i: F.when((F.size(kept) == 0) | (i - F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(-(1 << 30))) >= apart), F.concat(kept, F.array(i))).otherwise(kept),
    )


def ensemble_anomalies(df: DataFrame, keys=KEYS, period: int | None = None) -> DataFrame:
    """Anomalous rows with one kind each: level_shift before seasonal before spike."""
    flagged = anomaly_flags(df, keys)
    flagged = phase_residual_flags(flagged, period, keys) if period else flagged.withColumn("is_seasonal", F.lit(False))
    shifts = cusum_shifts(df, keys).select(*keys, F.explode("shifts").alias("seq"), F.lit(True).alias("__shift"))
    both = flagged.join(shifts, [*keys, "seq"], "left")
    kind = F.when(F.col("__shift"), "level_shift").when(F.col("is_seasonal"), "seasonal").when(F.col("is_iqr") | F.col("is_mad"), "spike")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "seq", "value", "kind")


# Seasonality.
def variance_ratio(df: DataFrame, period: int, keys=KEYS) -> DataFrame:
    """Per series: mean of the phases' variances over the whole variance."""
    phases = df.groupBy(*keys, (F.col("seq") % period).alias("__ph")).agg(F.var_pop("value").alias("__v"))
    total = df.groupBy(*keys).agg(F.var_pop("value").alias("__t"))
    return phases.groupBy(*keys).agg(F.avg("__v").alias("__v")).join(total, list(keys)).select(
        *keys, F.lit(period).alias("period"), F.when(F.col("__t") > GUARD, F.try_divide("__v", "__t")).otherwise(F.lit(1.0)).alias("variance_ratio")
    )


def month_seasonality(df: DataFrame, keys=KEYS, ts: str = "ts") -> DataFrame:
    """Per series: variance of month means over the variance of all; seasonal from 0.15 with six months or more."""
    means = df.groupBy(*keys, F.month(ts).alias("__m")).agg(F.avg("value").alias("__a"))
    between = means.groupBy(*keys).agg(
        F.var_pop("__a").alias("__b"), F.count(F.lit(1)).alias("months"),
        F.max_by("__m", F.struct(F.col("__a"), -F.col("__m"))).alias("peak_month"), F.min_by("__m", F.struct(F.col("__a"), F.col("__m"))).alias("trough_month"),
    )
    total = df.groupBy(*keys).agg(F.var_pop("value").alias("__t"))
    ratio = F.when(F.col("__t") > GUARD, F.try_divide("__b", "__t")).otherwise(F.lit(0.0))
    return between.join(total, list(keys)).select(*keys, "months", ratio.alias("ratio"), ((ratio >= 0.15) & (F.col("months") >= 6)).alias("seasonal"), "peak_month", "trough_month")


def dominant_frequency(seq: np.ndarray, residual: np.ndarray) -> tuple[int, float]:
    """(k, share of the power) of the strongest of the frequencies 1..n/2; of equal ones (to a billionth) the lowest."""
    n = len(seq)
    placed = np.bincount(np.asarray(seq, dtype=np.int64) % n, weights=residual, minlength=n)
    power = np.abs(np.fft.rfft(placed)[1:]) ** 2
    k = int(np.flatnonzero(power >= power.max() * (1 - 1e-9))[0])
    total = power.sum()
    return k + 1, float(power[k] / total) if total > GUARD else 0.0


def spectral_peak(df: DataFrame, keys=KEYS) -> DataFrame:
    """Per series of at least four points: strongest frequency k in 1..n/2 of the detrended values, its share of the power, its period.

    A fast Fourier transform in a grouped map: a row a point goes in, n log n steps.
    """
    names = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in names) + ", k int, period double, power_share double"

    def peak(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.dropna(subset=["residual"])
        if len(pdf) < 4 or not len(known):
            return pd.DataFrame(columns=[*names, "k", "period", "power_share"], dtype=object)
        k, share = dominant_frequency(pdf["seq"].to_numpy(), pdf["residual"].fillna(0.0).to_numpy(dtype=float))
        return pd.DataFrame([(*(pdf[c].iloc[0] for c in names), k, len(pdf) / k, share)], columns=[*names, "k", "period", "power_share"])

    return detrended(df, keys).select(*names, "seq", "residual").groupBy(*names).applyInPandas(peak, schema)


def detect_seasonality(df: DataFrame, keys=KEYS, periods: tuple[int, ...] = (3, 4, 6, 12), most_ratio: float = 0.6, least_acf: float = 0.25) -> DataFrame:
    """A row per series and candidate period that the series covers 1.5 times, with the tests it passes.

    A period is detected if autocorrelation and variance ratio agree, or if the
    spectral peak and one of them do; a series whose detrended deviation is under
    5% of its own has none.
    """
    flat = detrended(df, keys).withColumn("__sd", F.stddev_pop("value").over(whole(keys)))
    shape = flat.groupBy(*keys).agg((F.stddev_pop("residual") >= 0.05 * F.max("__sd")).alias("moving"))
    plain = flat.select(*keys, "seq", F.col("residual").alias("value"))
    acf = autocorrelation(plain, list(periods), "value", keys)
    ratios = [variance_ratio(plain, p, keys) for p in periods]
    every = ratios[0]
    for r in ratios[1:]:
        every = every.union(r)
    peak = spectral_peak(df, keys).select(*keys, F.col("period").alias("__peak"))
    joined = acf.withColumnRenamed("lag", "period").where(F.col("n") >= 1.5 * F.col("period")).join(every, [*keys, "period"]).join(shape, list(keys)).join(peak, list(keys), "left")
    a = F.col("acf") >= F.greatest(F.lit(least_acf), 1.96 / F.sqrt(F.col("n").cast("double")))
    v = F.col("variance_ratio") <= most_ratio
    s = F.coalesce(F.abs(F.col("__peak") - F.col("period")) < 0.5, F.lit(False))
    return joined.select(*keys, "period", "acf", "variance_ratio", (F.col("moving") & ((a & v) | (s & (a | v)))).alias("detected"))


# Change points.
def structural_break(df: DataFrame, keys=KEYS, least: int = 6, score: float = 0.95, least_shift: float = 5.0) -> DataFrame:
    """Per series: the split with the largest difference of mean residuals, in deviations, and the difference of its raw means."""
    r = detrended(df, keys)
    w, all_ = along(keys), whole(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cut = r.withColumns({
        "__n": F.count(F.lit(1)).over(all_), "__ln": F.row_number().over(w) - 1, "__s": F.stddev_pop("residual").over(all_),
        "__l": F.sum("residual").over(before), "__t": F.sum("residual").over(all_), "__rl": F.sum("value").over(before), "__rt": F.sum("value").over(all_),
    })
    cut = cut.where((F.col("__ln") >= least) & (F.col("__n") - F.col("__ln") >= least))
    gap = lambda left, total: F.abs((total - left) / (F.col("__n") - F.col("__ln")) - left / F.col("__ln"))
    cut = cut.withColumns({"__score": gap(F.col("__l"), F.col("__t")) / F.greatest(F.col("__s"), F.lit(GUARD)), "__d": gap(F.col("__rl"), F.col("__rt"))})
    # Scores that differ by rounding only are ties; the first split wins.
    best = cut.groupBy(*keys).agg(F.max_by(F.struct("seq", "__d", "__score"), F.struct(F.round("__score", 9), -F.col("seq"))).alias("b"))
    return best.select(*keys, F.col("b.seq").alias("break_at"), F.col("b.__score").alias("score"), F.col("b.__d").alias("shift"), ((F.col("b.__score") >= score) & (F.col("b.__d") >= least_shift)).alias("is_break"))


def _split(x: np.ndarray, lo: int, hi: int, least: int) -> tuple[float, int | None]:
    """Largest drop in squared error from cutting x[lo:hi] once."""
    part = x[lo:hi]
    n = len(part)
    if n < 2 * least:
        return 0.0, None
    s, q = np.cumsum(part), np.cumsum(part * part)
    k = np.arange(least, n - least + 1)
    left = q[k - 1] - s[k - 1] ** 2 / k
    right = (q[-1] - q[k - 1]) - (s[-1] - s[k - 1]) ** 2 / (n - k)
    gain = (q[-1] - s[-1] ** 2 / n) - left - right
    best = int(gain.argmax())
    return float(gain[best]), lo + int(k[best])


def binary_segmentation(df: DataFrame, keys=KEYS, least: int = 4, most: int = 5, least_share: float = 0.15, penalty: float = 2.0) -> DataFrame:
    """Per series: change points by recursive best splits, left part first, until there are `most`.

    A split's drop in squared error, less `penalty` x ln(length of the segment),
    must be `least_share` of the segment's squared error.
    """
    keys = list(keys)

    def points(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("seq")["value"].to_numpy(dtype=np.float64)
        x = x - x.mean()
        found: list[int] = []
        open_parts = [(0, len(x))]
        while open_parts and len(found) < most:
            lo, hi = open_parts.pop()
            gain, at = _split(x, lo, hi, least)
            error = float(((x[lo:hi] - x[lo:hi].mean()) ** 2).sum()) if hi > lo else 0.0
            if at is None or error < GUARD:
                continue
            net = gain - penalty * np.log(max(hi - lo, 2))
            if net > 0 and net >= least_share * error:
                found.append(at)
                open_parts += [(at, hi), (lo, at)]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), sorted(found)]], columns=[*keys, "changepoints"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return df.groupBy(*keys).applyInPandas(points, f"{schema}, changepoints array<int>")


def changepoints(df: DataFrame, keys=KEYS, within: int = 2, beside: int = 4) -> DataFrame:
    """A row per change point of either method, merged: the methods within `within` of it, confirmed by both, and the level shift.

    The shift is the difference of the means of up to `beside` values on either
    side; relative to the left one it is an increase or a decrease beyond 2%.
    """
    a = two_sided_cusum(df, keys).select(*keys, F.col("changepoints").alias("__a"))
    b = binary_segmentation(df, keys).select(*keys, F.col("changepoints").alias("__b"))
    both = a.join(b, list(keys)).join(packed(df, keys), list(keys)).where(F.size("xs") >= 2 * beside)
    each = both.withColumn("at", F.explode(merge_nearby(F.array_union("__a", "__b"), max(2, beside // 2))))
    near = lambda c: F.exists(c, lambda y: F.abs(y - F.col("at")) <= within)
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v) / F.size(part)
    left = F.slice("xs", F.greatest(F.col("at") - beside, F.lit(0)) + 1, F.least(F.col("at"), F.lit(beside)))
    right = F.slice("xs", F.col("at") + 1, beside)
    each = each.withColumns({"cusum": near("__a"), "segmentation": near("__b"), "left_mean": mean(left), "right_mean": mean(right)})
    shift = F.col("right_mean") - F.col("left_mean")
    relative = shift / F.greatest(F.abs("left_mean"), F.lit(GUARD))
    return each.select(*keys, "at", "cusum", "segmentation", (F.col("cusum") & F.col("segmentation")).alias("confirmed"), "left_mean", "right_mean", shift.alias("shift"), relative.alias("relative"), F.when(relative > 0.02, "increase").when(relative < -0.02, "decrease").otherwise("stable").alias("direction"))


# Exponential smoothing.
def holt_linear(df: DataFrame, keys=KEYS, grid: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8), horizon: int = 3) -> DataFrame:
    """Per series: the level and trend smoothing with the least squared error, and its forecasts.

    The grid is exploded beside each series and each candidate is one fold.
    """
    xs = packed(df, keys).where(F.size("xs") >= 3)
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in grid for b in grid))
    tried = xs.withColumn("p", F.explode(pairs))
    a, b = F.col("p.a"), F.col("p.b")
    start = F.struct(F.get("xs", F.lit(0)).alias("level"), (F.get("xs", F.lit(1)) - F.get("xs", F.lit(0))).alias("trend"), F.lit(0.0).alias("sse"))

    def step(acc: Column, x: Column) -> Column:
        guess = acc["level"] + acc["trend"]
        level = a * x + (1 - a) * guess
        return F.struct(level.alias("level"), (b * (level - acc["level"]) + (1 - b) * acc["trend"]).alias("trend"), (acc["sse"] + (x - guess) * (x - guess)).alias("sse"))

    done = tried.withColumn("f", F.aggregate(F.slice("xs", 2, F.size("xs") - 1), start, step))
    best = done.groupBy(*keys).agg(F.min_by(F.struct("p", "f"), F.struct("f.sse", "p.a", "p.b")).alias("m"))
    return best.select(
        *keys, F.col("m.p.a").alias("alpha"), F.col("m.p.b").alias("beta"), F.col("m.f.sse").alias("sse"),
        *((F.col("m.f.level") + h * F.col("m.f.trend")).alias(f"step_{h}") for h in range(1, horizon + 1)),
    )


def holt_winters(df: DataFrame, keys=KEYS, season: int = 12, grid: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8), horizon: int = 3) -> DataFrame:
    """Additive seasonal smoothing over a grid of 64, for series of two seasons or more (one row each)."""
    keys = list(keys)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("seq")["value"].to_numpy(dtype=np.float64)
        names = [*keys, "alpha", "beta", "gamma", "sse", *(f"step_{h}" for h in range(1, horizon + 1))]
        if len(x) < 2 * season:
            return pd.DataFrame(columns=names)
        g = np.array([(a, b, c) for a in grid for b in grid for c in grid])
        a, b, c = g.T
        whole_seasons = x[: len(x) // season * season].reshape(-1, season)
        season_state = np.repeat((whole_seasons - whole_seasons.mean(axis=1, keepdims=True)).mean(axis=0)[None], len(g), axis=0)
        level = np.full(len(g), x[:season].mean())
        trend = np.full(len(g), (x[season : 2 * season].mean() - x[:season].mean()) / season)
        sse = np.zeros(len(g))
        for i, v in enumerate(x):
            s = season_state[:, i % season].copy()
            guess = level + trend + s
            sse += (v - guess) ** 2
            new = a * (v - s) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            level = new
            season_state[:, i % season] = c * (v - level) + (1 - c) * s
        k = int(sse.argmin())
        ahead = [level[k] + h * trend[k] + season_state[k, (len(x) + h - 1) % season] for h in range(1, horizon + 1)]
        return pd.DataFrame([[*(pdf[n].iloc[0] for n in keys), *g[k], sse[k], *ahead]], columns=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    numbers = ", ".join(f"{n} double" for n in ("alpha", "beta", "gamma", "sse", *(f"step_{h}" for h in range(1, horizon + 1))))
    return df.groupBy(*keys).applyInPandas(smooth, f"{schema}, {numbers}")


# Relations between metrics of one entity.
def tail_pairs(df: DataFrame, entity: str = "entity", metric: str = "metric", ordered: bool = False) -> DataFrame:
    """entity, a, b, back, x, y: two metrics of one entity aligned by position from the end."""
    back = F.row_number().over(Window.partitionBy(entity, metric).orderBy(F.desc("seq")))
    one = df.withColumn("back", back)
    left = one.select(entity, F.col(metric).alias("a"), "back", F.col("value").alias("x"))
    right = one.select(entity, F.col(metric).alias("b"), "back", F.col("value").alias("y"))
    test = F.col("a") != F.col("b") if ordered else F.col("a") < F.col("b")
    return left.join(right, [entity, "back"]).where(test)


def _corr(x: str, y: str) -> Column:
    """corr() of a constant raises; such a pair is null."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > GUARD) & (sy > GUARD), F.try_divide(F.covar_pop(x, y), sx * sy))


def pearson_pairs(df: DataFrame, least: int = 5) -> DataFrame:
    pairs = tail_pairs(df).groupBy("entity", "a", "b").agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("r"))
    return pairs.where(F.col("n") >= least)


def spearman_pairs(df: DataFrame, least: int = 5) -> DataFrame:
    """Pearson over average ranks of the shared positions."""
    p = tail_pairs(df)
    for col, name in (("x", "rx"), ("y", "ry")):
        ties = F.count(F.lit(1)).over(Window.partitionBy("entity", "a", "b", col))
        p = p.withColumn(name, F.rank().over(Window.partitionBy("entity", "a", "b").orderBy(col)) + (ties - 1) / 2)
    return p.groupBy("entity", "a", "b").agg(F.count(F.lit(1)).alias("n"), _corr("rx", "ry").alias("rho")).where(F.col("n") >= least)


def significant_pairs(pairs: DataFrame, r: str = "r", least: float = 0.25, alpha: float = 0.1) -> DataFrame:
    """Pairs with |r| and p-value good enough."""
    return pairs.where(F.col(r).isNotNull()).withColumn("p_value", correlation_p_value(F.col(r), F.col("n"))).where((F.abs(r) >= least) & (F.col("p_value") <= alpha))


def cross_correlation(df: DataFrame, max_lag: int = 6, least: int = 5) -> DataFrame:
    """A row per pair of metrics: the lag with the largest |r| (smallest lag first); a leads b if it is positive."""
    p = tail_pairs(df)
    shifted = p.select("entity", "a", "b", F.col("back").alias("__ba"), "x").withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    moved = shifted.withColumn("back", F.col("__ba") - F.col("lag"))
    joined = moved.join(p.select("entity", "a", "b", "back", "y"), ["entity", "a", "b", "back"])
    per = joined.groupBy("entity", "a", "b", "lag").agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull())
    best = per.groupBy("entity", "a", "b").agg(F.max_by(F.struct("lag", "n", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("m"))
    return best.select("entity", "a", "b", "m.lag", "m.n", "m.r", (F.abs("m.r") >= 1.96 / F.sqrt(F.col("m.n").cast("double"))).alias("significant"))


def lead_lag_roles(ccf: DataFrame) -> DataFrame:
    """Per entity and metric: how often it leads, lags and coincides, and its role."""
    ok = ccf.where("significant")
    sides = ok.select("entity", F.col("a").alias("metric"), F.col("lag")).union(ok.select("entity", F.col("b"), -F.col("lag")))
    n = sides.groupBy("entity", "metric").agg(*(F.count(F.when(t, 1)).alias(c) for c, t in (("leads", F.col("lag") > 0), ("lags", F.col("lag") < 0), ("coincides", F.col("lag") == 0))))
    role = F.when((F.col("leads") > F.col("lags")) & (F.col("leads") >= F.col("coincides")), "leading").when((F.col("lags") > F.col("leads")) & (F.col("lags") >= F.col("coincides")), "lagging").otherwise("coincident")
    return n.withColumn("role", role)


def variance_decomposition(df: DataFrame, entity: str = "entity") -> DataFrame:
    """Population variance of each metric and its share in the entity's sum."""
    v = df.groupBy(entity, "metric").agg(F.var_pop("value").alias("variance"))
    total = F.sum("variance").over(Window.partitionBy(entity))
    return v.withColumn("share", F.when(total > GUARD, F.try_divide("variance", total)).otherwise(F.lit(0.0)))


def granger(df: DataFrame, max_lag: int = 4, least: int = 12) -> DataFrame:
    """Ordered pairs of an entity's metrics: best lag and F of the lagged regression, with and without the cause."""
    pairs = tail_pairs(df, ordered=True)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("back", ascending=False)
        x, y = p["x"].to_numpy(dtype=np.float64), p["y"].to_numpy(dtype=np.float64)
        best = (-1.0, 0, 0, 0)
        for lag in range(1, max_lag + 1):
            n = len(y) - lag
            dof = n - 2 * lag - 1
            if len(y) < least or dof < 1:
                continue
            own = np.column_stack([np.ones(n), *(y[lag - j : len(y) - j] for j in range(1, lag + 1))])
            full = np.column_stack([own, *(x[lag - j : len(x) - j] for j in range(1, lag + 1))])
            rss = [float(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, full)]
            f = max(0.0, (rss[0] - rss[1]) / lag) / max(rss[1] / dof, 1e-12)
            if f > best[0]:
                best = (f, lag, lag, dof)
        row = [p["entity"].iloc[0], p["a"].iloc[0], p["b"].iloc[0], best[1], best[0], best[2], best[3]]
        return pd.DataFrame([row] if best[0] >= 0 else [], columns=["entity", "cause", "effect", "lag", "f", "df1", "df2"])

    return pairs.groupBy("entity", "a", "b").applyInPandas(test, "entity string, cause string, effect string, lag int, f double, df1 int, df2 int")


# Survival.
def survival_curve(df: DataFrame, keys, duration: str = "duration", observed: str = "observed") -> DataFrame:
    """A row per group and time, of events or not: at_risk, events, survival and Greenwood's 95% bounds."""
    n = F.sum("__c").over(Window.partitionBy(*keys))
    t = df.groupBy(*keys, duration).agg(F.count(F.lit(1)).alias("__c"), F.sum(F.col(observed).cast("int")).alias("events"))
    w = Window.partitionBy(*keys).orderBy(duration)
    before = F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("at_risk", n - before)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    left = 1 - F.col("events") / F.col("at_risk")
    # The product as a sum of logs; once nobody is left it stays 0.
    gone = F.max(F.when(left <= 0, 1).otherwise(0)).over(upto)
    s = F.when(gone == 1, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(F.when(left > 0, left))).over(upto)))
    var = F.sum(F.try_divide(F.col("events").cast("double"), F.col("at_risk") * (F.col("at_risk") - F.col("events")))).over(upto)
    out = t.withColumns({"survival": s, "__var": F.coalesce(var, F.lit(0.0))})
    half = 1.96 * F.col("survival") * F.sqrt("__var")
    return out.select(*keys, duration, "at_risk", "events", "survival", clip(F.col("survival") - half, 0.0, 1.0).alias("lower"), clip(F.col("survival") + half, 0.0, 1.0).alias("upper"))


def kaplan_meier(df: DataFrame, keys, duration: str = "duration", observed: str = "observed") -> DataFrame:
    """The rows of survival_curve() at event times."""
    return survival_curve(df, keys, duration, observed).where("events > 0")


def median_survival(km: DataFrame, keys, duration: str = "duration") -> DataFrame:
    """First time at which half or fewer are left; null if more remain."""
    return km.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5, F.col(duration))).alias("median"))


def restricted_mean(df: DataFrame, keys, duration: str = "duration", observed: str = "observed") -> DataFrame:
    """Per group: the area under the survival curve from 1 at time 0 over all times, of events or not, by trapezoids."""
    w = Window.partitionBy(*keys).orderBy(duration)
    curve = survival_curve(df, keys, duration, observed)
    wide = F.col(duration) - F.coalesce(F.lag(duration).over(w), F.lit(0))
    area = wide * (F.col("survival") + F.coalesce(F.lag("survival").over(w), F.lit(1.0))) / 2
    return curve.withColumn("__a", area).groupBy(*keys).agg(F.sum("__a").alias("mean_survival"))


def retention_survival(df: DataFrame, keys, retention: str = "retention") -> DataFrame:
    """Survival scaled to its first value, hazard and cumulative hazard (-ln of survival) of a retention curve by seq."""
    w = along(keys)
    first = F.first(retention).over(w.rowsBetween(Window.unboundedPreceding, 0))
    scaled = df.withColumn("survival", clip(F.try_divide(F.col(retention), first), 0.0, 1.0))
    before = F.lag("survival").over(w)
    hazard = F.when(before > GUARD, F.greatest(F.lit(0.0), 1 - F.try_divide("survival", before))).otherwise(F.lit(0.0))
    out = scaled.withColumn("hazard", F.when(before.isNull(), F.lit(0.0)).otherwise(hazard))
    return out.withColumn("cumulative_hazard", -F.ln(F.greatest("survival", F.lit(GUARD))))


def hazard_trend(df: DataFrame, keys) -> DataFrame:
    """Mean hazard of the last third of the periods after the first less that of the first third: increasing or decreasing beyond 0.02.

    Fewer than three such periods are too little data.
    """
    later = df.withColumn("__i", F.row_number().over(along(keys)) - 1).where("__i > 0")
    later = later.withColumn("__n", F.count(F.lit(1)).over(whole(keys)))
    third = F.greatest(F.floor(F.col("__n") / 3), F.lit(1))
    part = later.withColumn("__p", F.when(F.col("__i") <= third, 0).when(F.col("__i") > F.col("__n") - third, 2).otherwise(1))
    late, early = (F.avg(F.when(F.col("__n") >= 3, F.when(F.col("__p") == p, F.col("hazard")))) for p in (2, 0))
    d = part.groupBy(*keys).agg((late - early).alias("change"))
    trend = F.when(F.col("change").isNull(), "insufficient_data").when(F.col("change") > 0.02, "increasing").when(F.col("change") < -0.02, "decreasing").otherwise("stable")
    return d.withColumn("trend", trend)


def synthetic_retention(churn: Column, periods: int = 12) -> Column:
    """Geometric retention over `periods` from one churn rate."""
    return F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda k: F.pow(1 - churn, k))


# Summaries.
def halves_trend(df: DataFrame, keys=KEYS) -> DataFrame:
    """Mean of the second half against the first: growing or declining beyond 5%."""
    n, i = F.count(F.lit(1)).over(whole(keys)), F.row_number().over(along(keys)) - 1
    side = df.withColumn("__h", i >= F.floor(n / 2))
    m = side.groupBy(*keys).agg(F.avg(F.when(~F.col("__h"), F.col("value"))).alias("first_half"), F.avg(F.when(F.col("__h"), F.col("value"))).alias("second_half"))
    change = (F.col("second_half") - F.col("first_half")) / F.greatest(F.abs("first_half"), F.lit(GUARD))
    return m.withColumn("change", change).withColumn("trend", F.when(F.col("change") > 0.05, "growing").when(F.col("change") < -0.05, "declining").otherwise("stable"))


def volatility_label(df: DataFrame, keys=KEYS) -> DataFrame:
    cv = df.groupBy(*keys).agg((F.stddev_pop("value") / F.greatest(F.abs(F.avg("value")), F.lit(GUARD))).alias("cv"))
    return cv.withColumn("volatility", F.when(F.col("cv") < 0.1, "low").when(F.col("cv") < 0.3, "moderate").otherwise("high"))


def implied_churn(df: DataFrame, keys=KEYS) -> DataFrame:
    """Churn that falling periods suggest: min(0.5, 0.7 x mean fall) if at least 40% fall; null below 0.01 or four points."""
    g = df.withColumn("__g", F.when(F.abs(F.lag("value").over(along(keys))) >= GUARD, period_growth("value", keys)))
    a = g.groupBy(*keys).agg(
        F.count("value").alias("n"), F.count("__g").alias("changes"), F.count(F.when(F.col("__g") < 0, 1)).alias("falls"), F.avg(F.when(F.col("__g") < 0, -F.col("__g"))).alias("__f")
    )
    implied = F.least(F.lit(0.5), 0.7 * F.col("__f"))
    ok = (F.col("n") >= 4) & (F.col("falls") >= 0.4 * F.col("changes")) & (implied >= 0.01)
    return a.select(*keys, "changes", "falls", F.when(ok, implied).alias("implied_churn"))


def growth_efficiency(df: DataFrame, keys=KEYS) -> DataFrame:
    """Velocity, stability, half-over-half acceleration and decline ratio of the changes, with the burn risk."""
    g = df.withColumn("__g", F.when(F.abs(F.lag("value").over(along(keys))) >= GUARD, period_growth("value", keys))).where("__g is not null")
    n, i = F.count(F.lit(1)).over(whole(keys)), F.row_number().over(along(keys)) - 1
    h = g.withColumn("__late", i >= F.floor(n / 2))
    a = h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.avg("__g").alias("velocity"),
        F.stddev_pop("__g").alias("__s"),
        F.avg(F.when(F.col("__late"), F.col("__g"))).alias("__b"),
        F.avg(F.when(~F.col("__late"), F.col("__g"))).alias("__a"),
        F.avg((F.col("__g") < 0).cast("int")).alias("decline_ratio"),
    )
    cv = F.when(F.col("periods") >= 2, F.col("__s") / F.greatest(F.abs("velocity"), F.lit(GUARD))).otherwise(F.lit(0.0))
    risk = F.when((F.col("decline_ratio") > 0.6) & (F.col("cv") > 0.3), "high").when((F.col("decline_ratio") > 0.4) | (F.col("cv") > 0.5), "moderate").otherwise("low")
    return a.withColumn("cv", cv).select(*keys, "periods", "velocity", "cv", F.coalesce(F.col("__b") - F.col("__a"), F.lit(0.0)).alias("acceleration"), "decline_ratio", risk.alias("burn_risk"))


def forecast_direction(slope: Column) -> Column:
    return F.when(slope > 0.01, "up").when(slope < -0.01, "down").otherwise("flat")


def cohort_health(decay: Column) -> Column:
    return F.when(decay < 0.2, "strong").when(decay < 0.5, "moderate").otherwise("weak")
