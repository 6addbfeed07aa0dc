"""Window operators over position-indexed series (keys, seq, value).

Each adds columns to its input; `keys` names the columns of one series. All use
one shuffle on the keys, which later operators on the same keys reuse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, bands, clip, guarded_change, safe_divide
from tallygrove.operators.order import global_rank, with_ranks, with_totals

KEYS = ("entity", "metric")


def along(keys=KEYS, order: str = "seq"):
    return Window.partitionBy(*keys).orderBy(order)


def trailing(width: int, keys=KEYS, order: str = "seq"):
    return along(keys, order).rowsBetween(-(width - 1), 0)


def whole(keys=KEYS):
    return Window.partitionBy(*keys)


# Ranks.
def competition_rank(df: DataFrame, keys, value: str = "value", higher_is_better: bool = True) -> DataFrame:
    """rank (1224), n, percentile ((n - rank) / (n - 1) * 100), field_mean and field_median."""
    x = with_ranks(df, keys, value)
    above = F.col("__n") - F.col("__below") - F.col("__same")
    rank = ((above if higher_is_better else F.col("__below")) + 1).cast("int")
    means = df.groupBy(*keys).agg(F.avg(value).alias("__mean")).withColumnsRenamed({k: f"__m_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__m_{k}")) for k in keys))
    x = x.join(means, same, "left").withColumns({"rank": rank, "n": F.col("__n"), "field_mean": F.col("__mean"), "field_median": F.col("__median")})
    share = F.when(F.col("n") <= 1, F.lit(100.0)).otherwise(F.try_divide((F.col("n") - F.col("rank")).cast("double"), F.col("n") - 1) * 100)
    out = x.withColumn("percentile", share)
    return out.select(*df.columns, "rank", "n", "percentile", "field_mean", "field_median")


def overall_rank(ranked: DataFrame, entity: str = "entity") -> DataFrame:
    """Mean percentile over an entity's metrics, its rank, and the tier by percentile of that rank."""
    mean = ranked.groupBy(entity).agg(F.avg("percentile").alias("mean_percentile"), F.count(F.lit(1)).alias("metrics"))
    tier = bands(F.col("overall_percentile"), [(75.0, "leader"), (50.0, "strong"), (25.0, "average")], "weak")
    placed = with_totals(global_rank(mean, F.round("mean_percentile", 9), "overall_rank"), participants=F.count(F.lit(1)))
    pct = F.when(F.col("participants") <= 1, F.lit(100.0)).otherwise(F.try_divide((F.col("participants") - F.col("overall_rank")).cast("double"), F.col("participants") - 1) * 100)
    return placed.withColumn("overall_percentile", pct).withColumn("tier", tier)


def share_below(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """share_below: percentage of the other members of the group whose value is lower; 50 without others."""
    x = with_ranks(df, keys, value)
    n = F.col("__n") - 1
    return x.withColumn("share_below", F.when(n == 0, F.lit(50.0)).otherwise(F.try_divide(F.col("__below").cast("double"), n) * 100)).select(*df.columns, "share_below")


def average_rank(df: DataFrame, keys, value: str = "value", name: str = "midrank") -> DataFrame:
    """Ranks from 1, ties get the mean of their places."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2)


# Smoothing.
def rolling(df: DataFrame, width: int = 3, keys=KEYS) -> DataFrame:
    """rolling_mean and rolling_median of the last `width` values; shorter at the start."""
    frame = trailing(width, keys)
    return df.withColumns({"rolling_mean": F.avg("value").over(frame), "rolling_median": F.percentile("value", F.lit(0.5)).over(frame)})


def forward_fill(df: DataFrame, value: str = "value", keys=KEYS, name: str = "filled") -> DataFrame:
    return df.withColumn(name, F.last(value, ignorenulls=True).over(along(keys).rowsBetween(Window.unboundedPreceding, 0)))


# Growth.
def period_growth(value: str = "value", keys=KEYS, guard: float = GUARD) -> Column:
    return guarded_change(F.col(value), F.lag(value).over(along(keys)), guard)


def growth(df: DataFrame, keys=KEYS) -> DataFrame:
    """growth (guarded by a least denominator) and level_growth (null after a zero)."""
    before = F.lag("value").over(along(keys))
    return df.withColumns({"growth": period_growth("value", keys), "level_growth": F.try_divide(F.col("value") - before, before)})


def rolling_growth(df: DataFrame, width: int = 3, keys=KEYS) -> DataFrame:
    """rolling_growth: mean of the last `width` growth rates."""
    return df.withColumn("__g", period_growth("value", keys)).withColumn("rolling_growth", F.avg("__g").over(trailing(width, keys))).drop("__g")


def moving_growth(width: int, keys=KEYS, least: int | None = None) -> Column:
    """Change over `width` periods; with `least`, over the longest history of at least that many."""
    before = F.lag("value", width).over(along(keys))
    if least is not None:
        place = F.row_number().over(along(keys))
        first = F.first("value").over(along(keys).rowsBetween(Window.unboundedPreceding, 0))
        before = F.coalesce(before, F.when(place > least, first))
    return guarded_change(F.col("value"), before)


def cagr(periods: int, keys=KEYS) -> Column:
    """(end / start) ^ (1 / periods) - 1; null if the start is at or below the guard or the end is not positive."""
    start = F.lag("value", periods).over(along(keys))
    ok = (start > GUARD) & (F.col("value") > 0)
    return F.when(ok, F.pow(F.when(ok, F.col("value")) / F.when(ok, start), F.lit(1.0 / periods)) - 1)


def full_cagr(df: DataFrame, keys=KEYS) -> DataFrame:
    """Per series: compound growth from its first to its last value."""
    ends = df.where("value is not null").groupBy(*keys).agg(
        F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"), F.count(F.lit(1)).alias("n")
    )
    ok = (F.col("first") > GUARD) & (F.col("last") > 0) & (F.col("n") > 1)
    return ends.withColumn("cagr", F.when(ok, F.pow(F.when(ok, F.col("last") / F.col("first")), F.when(ok, 1 / (F.col("n") - 1))) - 1))


def growth_signals(df: DataFrame, keys=KEYS, short: int = 3, mid: int = 6, long: int = 12) -> DataFrame:
    """At each point: short, mid and long growth, cagr, and accelerations; null where history is short."""
    out = df.withColumns(
        {"short_growth": moving_growth(short, keys), "mid_growth": moving_growth(mid, keys), "long_growth": moving_growth(long, keys), "cagr": cagr(long, keys)}
    )
    s, m, g = F.col("short_growth"), F.col("mid_growth"), F.col("long_growth")
    return out.withColumns({"short_mid": s - m, "mid_long": m - g, "acceleration": s - 2 * m + g})


def latest(df: DataFrame, keys=KEYS, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last row of each series by `order`."""
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def deltas(df: DataFrame, keys=KEYS) -> DataFrame:
    """Last value of each series with its change over one and over three periods."""
    w = along(keys)
    marked = df.withColumns({"mom": safe_divide(F.col("value") - F.lag("value").over(w), F.abs(F.lag("value").over(w))), "qoq": safe_divide(F.col("value") - F.lag("value", 3).over(w), F.abs(F.lag("value", 3).over(w)))})
    return latest(marked, keys)


def compounded(df: DataFrame, rate: str, keys=KEYS, name: str = "compounded") -> DataFrame:
    """Running product of 1 + rate, less one; starts again after each null rate."""
    run = F.count(F.when(F.col(rate).isNull(), 1)).over(along(keys).rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(*keys, "__run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = F.exp(F.sum(F.ln(1 + F.col(rate))).over(inside)) - 1
    return df.withColumn("__run", run).withColumn(name, F.when(F.col(rate).isNotNull(), total)).drop("__run")


# State of a series.
def momentum(df: DataFrame, short: int = 3, long: int = 8, keys=KEYS) -> DataFrame:
    """(mean of the last short - mean of the last long) / |mean of the last long|; 0 while history is short."""
    a, b = F.avg("value").over(trailing(short, keys)), F.avg("value").over(trailing(long, keys))
    n = F.row_number().over(along(keys))
    return df.withColumn("momentum", F.when(n < long, F.lit(0.0)).otherwise((a - b) / F.greatest(F.abs(b), F.lit(GUARD))))


def volatility_regime(df: DataFrame, width: int = 6, high: float = 1.25, low: float = 0.8, keys=KEYS, keep_single: bool = False) -> DataFrame:
    """Per series: deviation of the last `width` returns against that of the earlier ones.

    Without enough earlier returns all returns are the baseline; with
    `keep_single` one earlier return is enough (its deviation then counts as the
    recent one).
    """
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
    returns = df.withColumns({"__g": period_growth("value", keys), "__b": back}).where("__g is not null")
    stats = returns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("returns"),
        F.stddev_pop(F.when(F.col("__b") <= width, F.col("__g"))).alias("recent"),
        F.stddev_pop(F.when(F.col("__b") > width, F.col("__g"))).alias("__before"),
        F.stddev_pop("__g").alias("__all"),
    )
    earlier = F.col("returns") - width
    base = F.when(earlier >= 2, F.col("__before")).when((earlier == 1) & F.lit(keep_single), F.col("recent")).otherwise(F.col("__all"))
    out = stats.withColumn("baseline", base).withColumn("ratio", F.col("recent") / F.greatest(F.col("baseline"), F.lit(GUARD)))
    regime = F.when(F.col("returns") < 2, "insufficient_history").when(F.col("ratio") >= high, "high").when(F.col("ratio") <= low, "low").otherwise("normal")
    return out.select(*keys, "returns", "recent", "baseline", "ratio", regime.alias("regime"))


def cycle_state(df: DataFrame, width: int = 8, up: float = 0.03, down: float = 0.03, peak: float = 0.8, trough: float = 0.2, keys=KEYS) -> DataFrame:
    """Last row of each series with its position in the last `width` values and the cycle's phase."""
    frame = trailing(width, keys)
    low, high = F.min("value").over(frame), F.max("value").over(frame)
    out = momentum(df, keys=keys).withColumn("position", F.when(high - low > GUARD, F.try_divide(F.col("value") - low, high - low)).otherwise(F.lit(0.5)))
    phase = (
        F.when(F.col("momentum") >= up, "expansion")
        .when(F.col("momentum") <= -down, "contraction")
        .when(F.col("position") >= peak, "peak")
        .when(F.col("position") <= trough, "trough")
        .otherwise("neutral")
    )
    return latest(out.withColumn("phase", phase), keys)


def lag_matrix(df: DataFrame, lags: int, keys=KEYS) -> DataFrame:
    """lag_1 .. lag_k, zero before the start."""
    return df.withColumns({f"lag_{k}": F.lag("value", k, 0.0).over(along(keys)) for k in range(1, lags + 1)})


def running_max(df: DataFrame, value: str, keys=KEYS, name: str = "running_max") -> DataFrame:
    return df.withColumn(name, F.max(value).over(along(keys).rowsBetween(Window.unboundedPreceding, 0)))


def churn_curve(df: DataFrame, retention: str, churn: str, keys) -> DataFrame:
    """Per series: mean loss of retention per step and mean second difference of churn (null below three points)."""
    w = along(keys)
    drop = F.greatest(F.lag(retention).over(w) - F.col(retention), F.lit(0.0))
    bend = F.col(churn) - 2 * F.lag(churn).over(w) + F.lag(churn, 2).over(w)
    return df.withColumns({"__d": drop, "__c": bend}).groupBy(*keys).agg(F.avg("__d").alias("decay"), F.avg("__c").alias("churn_acceleration"))


def level_shift(df: DataFrame, width: int = 3, keys=KEYS) -> DataFrame:
    """shift: mean of this and the next width-1 values less the mean of the width before, with its direction."""
    before = F.avg("value").over(along(keys).rowsBetween(-width, -1))
    after = F.avg("value").over(along(keys).rowsBetween(0, width - 1))
    change = safe_divide(after - before, F.abs(before))
    return df.withColumns({"shift": after - before, "direction": F.when(change > 0.02, "up").when(change < -0.02, "down").otherwise("flat")})


def minmax(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """value on a scale of 0..100 within its group."""
    low, high = F.min(value).over(whole(keys)), F.max(value).over(whole(keys))
    scaled = F.when(high - low <= GUARD, F.lit(50.0)).otherwise(clip(F.try_divide(F.col(value) - low, high - low) * 100, 0.0, 100.0))
    return df.withColumn(name, scaled)
