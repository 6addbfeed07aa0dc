"""Compositions: what one step of an analysis gathers from several operators.

Every function works on all entities at once and joins small per-entity or
per-series results; the series themselves are read by each operator below it
and are worth persisting by the caller who uses several of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators import confidence as G
from tallygrove.operators import joins as J
from tallygrove.operators import scenarios as N
from tallygrove.operators import scoring as R
from tallygrove.operators import series as S
from tallygrove.operators import windows as W

PAIR = ["entity", "metric"]


def timeseries_factors(series: DataFrame) -> DataFrame:
    """Per series: momentum, cycle position and phase, volatility regime, structural break."""
    cycle = W.cycle_state(series).select(*PAIR, "momentum", "position", "phase")
    regime = W.volatility_regime(series).select(*PAIR, "ratio", "regime")
    cut = S.structural_break(series).select(*PAIR, "break_at", F.col("score").alias("break_score"), "is_break")
    return cycle.join(regime, PAIR, "left").join(cut, PAIR, "left")


def growth_context(series: DataFrame) -> DataFrame:
    """Per series: growth over the horizons at its last point, whether history suffices, and a standard confidence."""
    last = W.latest(W.growth_signals(series))
    n = F.col("seq") + 1
    conf = G.series_confidence(series).select(*PAIR, "confidence")
    out = last.join(conf, PAIR)
    return out.select(
        *PAIR, "short_growth", "mid_growth", "long_growth", "cagr", "acceleration", (n >= 4).alias("short_ok"), (n >= 7).alias("mid_ok"), (n >= 13).alias("long_ok"),
        G.standard_confidence(F.col("confidence"), F.lit(1.0), F.lit(1.0), n >= 13).alias("confidence"),
    )


def growth_snapshot(context: DataFrame, metric: str) -> DataFrame:
    """Horizon growths of one metric, available if any horizon is."""
    some = F.coalesce("short_growth", "mid_growth", "long_growth").isNotNull()
    return context.where(F.col("metric") == metric).select("entity", "short_growth", "mid_growth", "long_growth", some.alias("available"))


def enrichment(series: DataFrame) -> DataFrame:
    """Per series: trend by halves, volatility label, forecast direction."""
    trend = S.halves_trend(series).select(*PAIR, "trend")
    vol = S.volatility_label(series).select(*PAIR, "volatility")
    slope = S.ols(series).select(*PAIR, S.forecast_direction(F.col("slope")).alias("direction"))
    return trend.join(vol, PAIR).join(slope, PAIR)


def forecasts_or_fallback(series: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Per series: the stored forecast (entity, metric, forecast, confidence), else the tiered model at 0.8 of its confidence."""
    own = S.tiered_forecast(series).select(*PAIR, "next_value", (F.col("confidence") * 0.8).alias("__c"), "tier")
    if stored is None:
        return own.select(*PAIR, F.col("next_value").alias("forecast"), F.col("__c").alias("confidence"), F.lit("fallback").alias("source"))
    s = stored.select(*PAIR, F.col("forecast").alias("__f"), F.col("confidence").alias("__s"))
    out = own.join(s, PAIR, "left")
    has = F.col("__f").isNotNull()
    return out.select(*PAIR, F.coalesce("__f", "next_value").alias("forecast"), F.coalesce("__s", "__c").alias("confidence"), F.when(has, "stored").otherwise("fallback").alias("source"))


def forecast_summary(series: DataFrame) -> DataFrame:
    """Per series: direction, and whether the fit allows to say so (four points and r_squared of 0.2)."""
    f = S.ols(series)
    return f.select(*PAIR, S.forecast_direction(F.col("slope")).alias("direction"), "r_squared", ((F.col("n") >= 4) & (F.col("r_squared") >= 0.2)).alias("valid"))


def residual_diagnostics(series: DataFrame) -> DataFrame:
    """Per series: Durbin-Watson and Ljung-Box of the detrended values, and a warning."""
    r = S.detrended(series)
    out = S.durbin_watson(r).join(S.ljung_box(r), PAIR, "left")
    dw = F.col("durbin_watson")
    warn = F.when(dw < 1.5, "positive_autocorrelation").when(dw > 2.5, "negative_autocorrelation").when(F.col("p_value") < 0.05, "autocorrelated_residuals")
    return out.withColumn("warning", warn)


def multivariate_scenarios(series: DataFrame, metric: str = "recurring_revenue") -> DataFrame:
    """Best, base and worst case of a metric with drag from its anomalies and from weak correlation to other metrics."""
    own = series.where(F.col("metric") == metric)
    flags = S.anomaly_flags(own).groupBy("entity").agg(F.count(F.when(F.col("is_iqr"), 1)).alias("__a"), F.max_by("value", "seq").alias("latest"))
    growth = W.latest(W.growth_signals(own)).select("entity", F.coalesce("short_growth", "mid_growth", "long_growth").alias("growth"))
    rho = S.spearman_pairs(series).groupBy("entity").agg(F.avg(F.abs("rho")).alias("__r"))
    conf = G.series_confidence(own).select("entity", "confidence")
    x = flags.join(growth, "entity").join(conf, "entity").join(rho, "entity", "left")
    weak = F.coalesce(1 - F.col("__r"), F.lit(1.0))
    return N.scenario_grid(x.select("entity", "latest", "growth", F.least(F.lit(0.2), F.col("__a") * 0.01).alias("anomaly_penalty"), (0.2 * weak).alias("correlation_penalty"), "confidence"))


def peer_snapshot(series: DataFrame, most: int = 10) -> DataFrame:
    """Per client: its peers by size, mean peer value, rank among them, per metric."""
    last = W.latest(series).select(*PAIR, "value")
    size = last.where("metric = 'recurring_revenue'").select("entity", "value")
    peers = J.peers_by_size(size, "entity", "value", most=most).select("client", "peer")
    own = last.select(F.col("entity").alias("client"), "metric", F.col("value").alias("own"))
    theirs = last.select(F.col("entity").alias("peer"), "metric", "value")
    met = own.join(peers, "client").join(theirs, ["peer", "metric"])
    return met.groupBy("client", "metric", "own").agg(F.count(F.lit(1)).alias("peers"), F.avg("value").alias("peer_mean"), (1 + F.count(F.when(F.col("value") > F.col("own"), 1))).alias("rank"))


def risk_with_snapshots(base: DataFrame) -> DataFrame:
    """Risk of an entity with forecast inputs met by, or filled from, the growth, scenario and cohort snapshots.

    base: entity, confidence; forecast (is there a usable one), slope, deviation,
    acceleration; revenue_delta, churn_delta; short_growth, mid_growth,
    long_growth, trend_acceleration; best_growth, worst_growth; cohort_acceleration.
    A usable forecast's slope is averaged with the middle growth, its deviation
    is at least the spread of the growths and of the scenarios, its acceleration
    at least the slowing of growth; without one the snapshots stand in. With
    fewer than two of five real dimensions the confidence falls by 0.4 (none:
    0.5), to 0.05 at least.
    """
    z, own = F.lit(0.0), F.coalesce("forecast", F.lit(False))
    mid, worst, cohort = F.col("mid_growth"), F.col("worst_growth"), F.col("cohort_acceleration")
    spread = F.abs(F.col("short_growth") - F.col("long_growth"))
    scenario = F.abs(F.col("best_growth") - F.col("worst_growth"))
    slowing = F.greatest(z, -F.col("trend_acceleration"))
    has_growth = F.coalesce("short_growth", "mid_growth", "long_growth").isNotNull()
    has_scenario = F.coalesce("best_growth", "worst_growth").isNotNull()
    proxy = ~own & (cohort.isNotNull() | has_growth | has_scenario)
    # A growth of exactly 0 gives way to the next, as a missing one does.
    stand_in = F.coalesce(F.when(mid != 0, mid), F.when(worst != 0, worst), z)
    slope = F.when(own, F.when(mid.isNotNull(), (F.coalesce("slope", z) + mid) / 2).otherwise(F.coalesce("slope", z))).otherwise(stand_in)
    deviation = F.greatest(F.when(own, F.coalesce("deviation", z)).otherwise(z), F.coalesce(spread, z), F.coalesce(scenario, z))
    acceleration = F.greatest(F.when(own, F.coalesce("acceleration", z)).otherwise(F.coalesce(cohort, z)), F.coalesce(slowing, z))
    growth_used = F.when(own, mid.isNotNull() | spread.isNotNull() | F.col("trend_acceleration").isNotNull()).otherwise(has_growth)
    scenario_used = F.when(own, scenario.isNotNull()).otherwise(has_scenario)
    dimensions = (F.col("revenue_delta").isNotNull() | F.col("churn_delta").isNotNull() | F.col("short_growth").isNotNull(), own, ~own & cohort.isNotNull(), growth_used, scenario_used)
    real = sum((F.coalesce(d, F.lit(False)).cast("int") for d in dimensions[1:]), F.coalesce(dimensions[0], F.lit(False)).cast("int"))
    out = base.withColumns({
        "source": F.when(own, "forecast").when(proxy & has_scenario, "scenario_growth_cohort_proxy").when(proxy & has_growth, "growth_cohort_proxy").when(proxy, "cohort_proxy").otherwise("insufficient_data"),
        "risk_score": R.risk_score(F.coalesce("short_growth", "revenue_delta"), F.col("churn_delta"), slope, deviation, acceleration, own | proxy),
        "dimensions": real,
    })
    less = F.when(F.col("dimensions") < 2, F.greatest(F.lit(0.05), F.col("confidence") - (0.3 + 0.1 * (2 - F.col("dimensions"))))).otherwise(F.col("confidence"))
    return out.select("entity", "source", "dimensions", "risk_score", R.risk_level(F.col("risk_score")).alias("level"), less.alias("confidence"))


def data_quality(parts: DataFrame) -> DataFrame:
    """entity, component, status, confidence -> per component: available, partial (too little data) or unavailable (failed, skipped), and its confidence."""
    out = F.col("status").isin("failed", "skipped")
    state = F.when(out, "unavailable").when(F.col("status") == "insufficient_data", "partial").otherwise("available")
    return parts.select("entity", "component", state.alias("state"), F.when(out, 0.0).otherwise(F.col("confidence")).alias("confidence"))


def missing_components(quality: DataFrame) -> DataFrame:
    """Per entity of data_quality(): how many components there are, and the unavailable ones by name."""
    gone = F.sort_array(F.collect_list(F.when(F.col("state") == "unavailable", F.col("component"))))  # a few components
    return quality.groupBy("entity").agg(F.count(F.lit(1)).alias("components"), gone.alias("missing"))


def kpi_rows_for(payload: DataFrame, metrics: tuple[str, ...], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Payload rows restricted to a branch's metrics and a period, with each entity's completeness."""
    rows = payload.where(F.col("metric").isin(*metrics))
    rows = rows if start is None else rows.where(F.col("month") >= start)
    rows = rows if end is None else rows.where(F.col("month") <= end)
    valid = F.count_distinct(F.when(F.col("is_valid"), F.col("metric")))
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), valid.alias("valid_metrics")).withColumn(
        "status", F.when(F.col("valid_metrics") == len(metrics), "success").when(F.col("valid_metrics") > 0, "partial").otherwise("failed")
    )


def formula_from_series(series: DataFrame) -> DataFrame:
    """The last churn, arpu and total revenue of each entity as its series give them."""
    value = lambda m, f: f(F.when(F.col("metric") == m, F.col("value")))
    last = W.latest(series).groupBy("entity").agg(value("active_customer_count", F.max).alias("active"), value("churned_customer_count", F.max).alias("churned"))
    total = series.where("metric = 'recurring_revenue'").groupBy("entity").agg(F.sum("value").alias("revenue"))
    return total.join(last, "entity").select("entity", "revenue", "active", F.try_divide("churned", "active").alias("churn_rate"), F.try_divide("revenue", "active").alias("arpu"))


def macro_context(series: DataFrame, inflation: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per entity of the revenue metric: seasonality, mean inflation over the series' span, gap to the benchmark's mean."""
    rev = series.where("metric = 'recurring_revenue'")
    season = S.month_seasonality(rev).select("entity", "seasonal")
    span = rev.groupBy("entity").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max_by("value", "seq").alias("last"))
    # Running sums by month, so that no task holds more than one month beside the sums of all.
    monthly = inflation.where("value is not null").withColumn("__month", F.trunc("period_end", "month"))
    within = Window.partitionBy("__month").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    sums = monthly.groupBy("__month").agg(F.sum("value").alias("__ms"), F.count("value").alias("__mn"))
    earlier = Window.orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)  # one row a month
    sums = sums.select("__month", F.coalesce(F.sum("__ms").over(earlier), F.lit(0.0)).alias("__ms"), F.coalesce(F.sum("__mn").over(earlier), F.lit(0)).alias("__mn"))
    run = monthly.join(F.broadcast(sums), "__month").select("period_end", (F.sum("value").over(within) + F.col("__ms")).alias("__s"), (F.count("value").over(within) + F.col("__mn")).alias("__n"))
    upto = J.asof(span, run, "b", "period_end", (), ("__s", "__n"))
    before = J.asof(span.select("entity", "a"), run.withColumn("period_end", F.date_add("period_end", 1)), "a", "period_end", (), ("__s", "__n")).select("entity", F.col("__s").alias("__s0"), F.col("__n").alias("__n0"))
    zero = F.lit(0)
    mean = F.try_divide(F.coalesce("__s", zero) - F.coalesce("__s0", zero), F.coalesce("__n", zero) - F.coalesce("__n0", zero))
    peer = benchmark.groupBy().agg(F.avg("value").alias("__p"))
    return upto.join(before, "entity").join(season, "entity").crossJoin(F.broadcast(peer)).select("entity", "seasonal", mean.alias("inflation"), F.try_divide(F.col("last") - F.col("__p"), F.abs("__p")).alias("benchmark_gap"))  # one row
