"""Confidence, gates and status rules as expressions and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, clip
from tallygrove.operators.series import anomaly_flags, detrended
from tallygrove.operators.windows import KEYS


def depth_score(n: Column, least: int = 3, full: int = 12) -> Column:
    return F.when(n < least, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.ln(F.greatest(n, F.lit(1)).cast("double")) / F.ln(F.lit(float(full)))))


def volatility_score(cv: Column, ceiling: float = 2.0, floor: float = 0.3) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), 1 - cv / ceiling))


def anomaly_score(n: Column, outliers: Column, each: float = 0.08, most: float = 0.5) -> Column:
    return F.when(n < 4, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(most), outliers * each)))


def consistency_score(positive: Column, negative: Column, each: float = 0.15, most: float = 0.7, known: Column | None = None) -> Column:
    score = F.greatest(F.lit(0.0), 1 - F.least(F.lit(most), positive * negative * each))
    return score if known is None else F.when(known < 2, F.lit(1.0)).otherwise(score)


def geometric_mean(*scores: Column) -> Column:
    logs = [F.ln(F.greatest(s, F.lit(GUARD))) for s in scores]
    return F.exp(sum(logs[1:], logs[0]) / len(scores))


def signal_directions(signals: DataFrame, keys=KEYS) -> DataFrame:
    """Per keys: how many signals are known, positive and negative."""
    v = F.col("value")
    return signals.groupBy(*keys).agg(F.count(v).alias("known"), F.count_if(v > GUARD).alias("positive"), F.count_if(v < -GUARD).alias("negative"))


def series_confidence(df: DataFrame, keys=KEYS, signals: DataFrame | None = None) -> DataFrame:
    """Per series: the four component scores, their geometric mean (0 below three points), and the signal pattern.

    signals: keys, signal, value. Signals of both directions lower the
    consistency, and the pattern is then `conflicting_indicators`; without
    signals a series is consistent.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) - 1
    marked = anomaly_flags(detrended(df, keys), keys).withColumns({"__n": n, "__i": i})
    third = F.greatest(F.lit(1), F.floor(F.col("__n") / 3))
    recent = F.greatest(F.lit(1), F.floor(F.col("__n") * 0.8))
    a = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.stddev_pop("residual") / F.greatest(F.abs(F.avg("value")), F.lit(GUARD))).alias("cv"),
        F.count(F.when(F.col("is_iqr"), 1)).alias("outliers"),
        F.count(F.when(F.col("is_iqr") & (F.col("__i") >= recent), 1)).alias("recent_outliers"),
        F.avg(F.when(F.col("__i") < third, F.col("value"))).alias("__early"),
        F.avg(F.when(F.col("__i") >= F.col("__n") - third, F.col("value"))).alias("__late"),
    )
    a = a.withColumns({"depth": depth_score(F.col("n")), "volatility": volatility_score(F.col("cv")), "anomaly": anomaly_score(F.col("n"), F.col("outliers"))})
    if signals is None:
        a = a.withColumns({"conflicts": F.lit(0).cast("long"), "consistency": F.lit(1.0)})
    else:
        a = a.join(signal_directions(signals, keys), list(keys), "left")
        none = F.lit(0).cast("long")
        up, down, known = (F.coalesce(c, none) for c in ("positive", "negative", "known"))
        a = a.withColumns({"conflicts": F.when(known < 2, none).otherwise(up * down), "consistency": consistency_score(up, down, known=known)}).drop("positive", "negative", "known")
    conf = F.when(F.col("depth") == 0, F.lit(0.0)).otherwise(clip(geometric_mean(F.col("depth"), F.col("volatility"), F.col("anomaly"), F.col("consistency")), 0.0, 1.0))
    volatile = (F.col("cv") > 0.15) | (F.col("volatility") < 0.85)
    up, down = F.col("__late") > F.col("__early"), F.col("__late") < F.col("__early")
    pattern = (
        F.when(F.col("n") < 3, "insufficient_data")
        .when(F.col("conflicts") > 0, "conflicting_indicators")
        .when(F.col("recent_outliers") > 0, "sudden_spike")
        .when(up & ~volatile, "stable_growth").when(up, "volatile_growth").when(down & ~volatile, "stable_decline").when(down, "volatile_decline").otherwise("neutral")
    )
    return a.select(*keys, "n", "cv", "outliers", "depth", "volatility", "anomaly", "consistency", conf.alias("confidence"), pattern.alias("pattern"))


def propagated(model: Column, dataset: Column, upstream: Column, weakest: Column | None = None) -> Column:
    """0.6 model + 0.2 dataset + 0.2 mean of upstream; at most 0.4 if an upstream is below 0.15."""
    total = 0.6 * model + 0.2 * dataset + 0.2 * F.coalesce(upstream, F.lit(1.0))
    capped = total if weakest is None else F.when(weakest < 0.15, F.least(total, F.lit(0.4))).otherwise(total)
    return clip(capped, 0.0, 1.0)


def standard_confidence(series: Column, dataset: Column, upstream: Column, sufficient: Column) -> Column:
    p = propagated(series, dataset, upstream)
    return F.when(sufficient, p).otherwise(F.least(F.lit(0.65), p * 0.8))


def conflict_penalty(base: Column, penalty: Column, floor: float = 0.1) -> Column:
    return F.greatest(F.lit(floor), base - penalty)


#: The forecast's weight in a blend, and the factor on its own confidence, by volatility regime.
FORECAST_WEIGHT = {"low": 0.35, "normal": 0.35, "high": 0.20, "insufficient_history": 0.15, "unknown": 0.25}
REGIME_FACTOR = {"low": 1.00, "normal": 0.92, "high": 0.75, "insufficient_history": 0.80, "unknown": 0.85}


def _by_regime(table: dict[str, float], regime: Column) -> Column:
    known = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(regime))
    return F.coalesce(known, F.lit(table["unknown"]))


def engine_confidence(series: Column, forecast: Column, status: Column, regime: Column, anomaly: Column, churn: Column) -> Column:
    """Series and forecast weighted by volatility regime; 0.85 of the series alone where `forecast` is null.

    Less 0.08 for an anomaly and 0.12 for a churn of 10% or more; at most 0.45
    if the forecast had too little data, 0.80 if the regime is high, 0.99 at all.
    """
    w = _by_regime(FORECAST_WEIGHT, regime)
    own = F.coalesce(series, F.lit(0.0))
    mixed = F.when(forecast.isNotNull(), (1 - w) * own + w * forecast).otherwise(0.85 * own)
    less = mixed - F.when(anomaly, 0.08).otherwise(0.0) - F.when(churn >= 0.1, 0.12).otherwise(0.0)
    less = F.when(status == "insufficient_data", F.least(less, F.lit(0.45))).otherwise(less)
    less = F.when(forecast.isNotNull() & (F.lower(regime) == "high"), F.least(less, F.lit(0.80))).otherwise(less)
    return clip(less, 0.0, 0.99)


def composite_confidence(bundle: Column, insight: Column, strategy: Column) -> Column:
    """0.40, 0.35, 0.25 over the parts that are there."""
    parts = ((bundle, 0.40), (insight, 0.35), (strategy, 0.25))
    top = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for x, w in parts), F.lit(0.0))
    return F.coalesce(F.try_divide(top, weight), F.lit(0.0))


# Gates.
def gate(status: Column, confidence: Column) -> Column:
    """block a failed signal, isolate one below 0.2 that is no success, degrade one of too little data or below 0.3, else pass."""
    known = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(known.isin("failed", "blocked"), "block")
        .when((confidence < 0.2) & (known != "success"), "isolate")
        .when((known == "insufficient_data") | (confidence < 0.3), "degrade")
        .otherwise("pass")
    )


def eligible(state: Column, allow_degraded: bool = True) -> Column:
    return state.isin("pass", "degrade") if allow_degraded else state == "pass"


def forecast_guardrail(status: Column, points: Column, tier: Column, r_squared: Column, confidence: Column, regime: Column) -> Column:
    """Why a forecast is rejected, first reason first; `accepted` if none applies.

    Its confidence, lowered by the volatility regime, must reach 0.30, or 0.40
    where the regime is high.
    """
    adjusted = clip(F.coalesce(confidence, F.lit(0.0)) * _by_regime(REGIME_FACTOR, regime), 0.0, 0.99)
    needed = F.when(F.lower(regime) == "high", 0.40).otherwise(0.30)
    return (
        F.when(F.lower(F.trim(F.coalesce(status, F.lit("")))) != "ok", "status_not_ok")
        .when(F.coalesce(points, F.lit(0)) < 6, "below_reliable_datapoint_threshold")
        .when(tier == "minimal", "minimal_tier_rejected")
        .when(r_squared < 0.30, "poor_regression_fit")
        .when(adjusted < needed, "volatility_adjusted_low_confidence")
        .otherwise("accepted")
    )


# Layers: each gives a struct of score, gate and state; a layer that is null is missing.
def log_saturating(n: Column) -> Column:
    """ln n / ln (n + 1), for n of 1 at least."""
    x = F.greatest(n, F.lit(1)).cast("double")
    return F.ln(x) / F.ln(x + 1)


def _layer(score: Column, state: Column, status: Column) -> Column:
    return F.struct(clip(score, 0.0, 1.0).alias("score"), state.alias("gate"), status.alias("status"))


def kpi_layer(available: Column, expected: Column, formula_share: Column, depth: Column) -> Column:
    """coverage x reliability (formula 1, backfill 0.7) x min(depth / 3, 1)."""
    score = F.coalesce(F.try_divide(available, expected), F.lit(0.0)) * (formula_share + 0.7 * (1 - formula_share)) * F.least(depth / 3, F.lit(1.0))
    return _layer(score, F.lit("pass"), F.lit("success"))


def forecast_layer(status: Column, points: Column, r_squared: Column, confidence: Column, horizon: Column, slope: Column, growth: Column) -> Column:
    """The model's confidence, or coverage x fit x horizon discount where it has none.

    Blocked if it failed, degraded (score 0) below six points, isolated for a fit
    under 0.10 (score: the fit) or, under 0.5, for a direction against the KPIs'
    growth, degraded for a fit under 0.30.
    """
    fit = clip(r_squared, 0.0, 1.0)
    own = log_saturating(points) * F.coalesce(fit, F.lit(1.0)) / (1 + F.ln(1 + F.greatest(F.coalesce(horizon, F.lit(3)), F.lit(0)).cast("double")))
    score = F.coalesce(clip(confidence, 0.0, 1.0), own)
    against = (F.signum(slope) * F.signum(growth) < 0) & (F.coalesce(fit, F.lit(1.0)) < 0.5)
    zero, of = F.lit(0.0), lambda s, g, why: _layer(s, F.lit(g), F.lit(why))
    return (
        F.when(status.isNull(), of(zero, "block", "missing"))
        .when(status.isin("failed", "skipped"), of(zero, "block", "failed"))
        .when((status == "insufficient_data") | (F.coalesce(points, F.lit(0)) < 6), of(zero, "degrade", "insufficient_data"))
        .when(fit < 0.10, of(fit, "isolate", "isolated_low_r2"))
        .when(against, of(score, "isolate", "isolated_direction_conflict"))
        .when(fit < 0.30, of(score, "degrade", "degraded_low_r2"))
        .otherwise(of(score, "pass", "success"))
    )


#: How far a source of peers is trusted; others 0.5.
SOURCE_RELIABILITY = {"local_db": 1.0, "deterministic_local": 1.0, "external_fetch": 0.7}


def competitive_completeness(benchmark_rows: Column, samples: Column, signals: Column) -> Column:
    """By benchmark rows, or without any by the samples behind the signals."""
    n, m = benchmark_rows.cast("double"), samples.cast("double")
    by_samples = F.sqrt(clip(F.ln(1 + m) / F.ln(25 + m), 0.0, 1.0) * log_saturating(signals + 1))
    return F.when(n > 0, clip(F.ln(1 + n) / F.ln(2 + n), 0.0, 1.0)).when(m > 0, by_samples).otherwise(F.lit(0.0))


def competitive_layer(peers: Column, metrics: Column, source: Column, completeness: Column) -> Column:
    """sqrt of the saturating terms of peers and metrics x reliability x completeness; degraded (score 0) below two of either."""
    trust = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_RELIABILITY.items() for x in kv)), F.lower(F.trim(source))), F.lit(0.5))
    score = F.sqrt(log_saturating(peers) * log_saturating(metrics)) * trust * completeness
    few = (peers < 2) | (metrics < 2)
    return F.when(few, _layer(F.lit(0.0), F.lit("degrade"), F.lit("insufficient_data"))).otherwise(_layer(score, F.lit("pass"), F.lit("success")))


def cohort_layer(cohorts: Column, middle: float = 0.3) -> Column:
    """0 without cohorts, `middle` with one, 1 from two (segments use 0.4); degraded up to 0.2."""
    score = F.when(cohorts <= 0, F.lit(0.0)).when(cohorts == 1, F.lit(middle)).otherwise(F.lit(1.0))
    return _layer(score, F.when(score > 0.2, "pass").otherwise("degrade"), F.when(score > 0, "success").otherwise("insufficient_data"))


#: Authority of the layers, halved for degraded ones.
AUTHORITY = {"kpi": 1.0, "cohort": 0.8, "segmentation": 0.6, "competitive": 0.5, "forecast": 0.4}
KPI_GATE = 0.3
CAP_KPI_DEGRADED, CAP_FORECAST_UNUSABLE, CAP_FEW_LAYERS = 0.35, 0.30, 0.25


def capped(confidence: Column, kpi_degraded: Column, forecast_usable: Column, valid_layers: Column) -> Column:
    """Confidence after the caps; the most restrictive wins."""
    one = F.when(kpi_degraded, F.least(confidence, F.lit(CAP_KPI_DEGRADED))).otherwise(confidence)
    two = F.when(~forecast_usable, F.least(one, F.lit(CAP_FORECAST_UNUSABLE))).otherwise(one)
    return clip(F.when(valid_layers < 3, F.least(two, F.lit(CAP_FEW_LAYERS))).otherwise(two), 0.0, 1.0)


def unified_integrity(layers: DataFrame, missing_required: DataFrame | None = None) -> DataFrame:
    """entity, layer, score, gate (missing layers have no row) -> integrity of an entity and what it rests on.

    Mean score by authority over layers that pass or are degraded and score 0.01
    at least; a squared penalty for a KPI layer under its gate; caps for a
    degraded KPI layer, an unusable forecast and fewer than three valid layers;
    a factor of max(0.5, 1 - 0.15 x n) for n missing required signals
    (missing_required: entity, missing).
    """
    authority = F.element_at(F.create_map(*(x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v)))), F.col("layer"))
    counts = F.col("gate").isin("pass", "degrade") & (F.col("score") >= 0.01)
    weight = F.coalesce(authority, F.lit(0.3)) * F.when(F.col("gate") == "degrade", 0.5).otherwise(1.0)
    of = lambda layer, x: F.max(F.when(F.col("layer") == layer, x))
    a = layers.withColumns({"__v": counts, "__w": F.when(counts, weight)}).groupBy("entity").agg(
        F.coalesce(F.sum(F.col("__w") * F.col("score")) / F.sum("__w"), F.lit(0.0)).alias("__raw"),
        F.count_if("__v").cast("int").alias("valid_layers"),
        of("kpi", F.col("score")).alias("__kpi"),
        F.coalesce(of("kpi", F.col("gate") == "degrade"), F.lit(False)).alias("kpi_degraded"),
        F.coalesce(of("forecast", F.col("gate").isin("pass", "degrade")), F.lit(False)).alias("forecast_usable"),
    )
    kpi = F.col("__kpi")
    penalty = F.when(kpi.isNull() | (kpi >= KPI_GATE), 1.0).otherwise((kpi / KPI_GATE) * (kpi / KPI_GATE))
    score = capped(clip(F.col("__raw") * penalty, 0.0, 1.0), F.col("kpi_degraded"), F.col("forecast_usable"), F.col("valid_layers"))
    n = F.lit(0)
    if missing_required is not None:
        a, n = a.join(missing_required.select("entity", F.col("missing").alias("__m")), "entity", "left"), F.coalesce("__m", F.lit(0))
    integrity = score * F.greatest(F.lit(0.5), 1 - 0.15 * n)
    quality = F.when((F.col("valid_layers") == 0) | (kpi == 0), "blocked").when(F.col("valid_layers") < 3, "partial_insight").otherwise("full_insight")
    gated = F.coalesce(kpi >= KPI_GATE, F.lit(False))
    return a.select("entity", "valid_layers", gated.alias("kpi_gate_passed"), "kpi_degraded", "forecast_usable", quality.alias("quality"), integrity.alias("integrity"))


def layer_states(layers: DataFrame) -> DataFrame:
    """entity, layer, state for all five layers: valid, degraded, isolated, inactive (scores nothing) or missing."""
    every = layers.select("entity").distinct().withColumn("layer", F.explode(F.array(*map(F.lit, AUTHORITY))))
    state = (
        F.when(F.col("gate").isNull(), "missing").when(F.col("gate").isin("block", "isolate"), "isolated").when(F.col("gate") == "degrade", "degraded")
        .when(F.col("score") >= 0.01, "valid").otherwise("inactive")
    )
    return every.join(layers, ["entity", "layer"], "left").select("entity", "layer", state.alias("state"))


def blocking_conflicts(severity: Column, worst: Column, conflicts: Column) -> Column:
    """Conflicts too severe to go on: one of 0.8 within a sum of 1.0, or three of any severity."""
    return ((worst >= 0.8) & (severity >= 1.0)) | (conflicts >= 3)


def audit(depth: Column, valid_layers: Column, coverage: Column, severity: Column) -> Column:
    """blocked without depth, layers or coverage; degraded below depth 3, coverage 0.5 or three layers, or for conflicts above 1.0; else pass."""
    some = F.coalesce(severity, F.lit(0.0)) > 1.0
    return (
        F.when((depth == 0) | (valid_layers == 0) | (coverage == 0), "blocked")
        .when((depth < 3) | (coverage < 0.5) | some | (valid_layers < 3), "degraded")
        .otherwise("pass")
    )


def completeness(have: Column, required: tuple[str, ...], optional: tuple[str, ...]) -> tuple[Column, Column]:
    """status and score: 0 if a required signal is missing, else 0.6 + 0.4 x share of optional ones."""
    lacking = F.size(F.array_except(F.array(*map(F.lit, required)), have))
    got = F.size(F.array_intersect(F.array(*map(F.lit, optional)), have)) if optional else F.lit(0)
    score = F.when(lacking > 0, F.lit(0.0)).otherwise(0.6 + 0.4 * got / max(1, len(optional)) if optional else F.lit(1.0))
    return F.when(lacking > 0, "failed").when(score < 1, "partial").otherwise("success"), score


FAMILIES = {"revenue": "revenue|mrr|sales", "churn": "churn|lost", "conversion": "conversion|signup"}


def readiness(series: DataFrame, depth: int = 2) -> DataFrame:
    """Per entity: which metric families have at least `depth` points, and whether all have."""
    per = series.groupBy("entity", F.lower("metric").alias("m")).agg(F.count("value").alias("n"))
    a = per.groupBy("entity").agg(*(F.max(((F.col("n") >= depth) & F.col("m").rlike(p)).cast("int")).cast("boolean").alias(f"has_{k}") for k, p in FAMILIES.items()))
    every = F.col("has_revenue") & F.col("has_churn") & F.col("has_conversion")
    return a.withColumn("ready", every)


def coverage(series: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Share of the expected metrics that an entity has; sufficient from one half."""
    have = series.where(F.col("metric").isin(*expected)).groupBy("entity").agg(F.count_distinct("metric").alias("__n"))
    every = series.select("entity").distinct().join(have, "entity", "left")
    share = F.coalesce("__n", F.lit(0)) / len(expected)
    return every.select("entity", share.alias("coverage"), (share >= 0.5).alias("sufficient"))


def pipeline_status(nodes: DataFrame) -> DataFrame:
    """entity, node, required, status -> failed if a required node is no success, partial if another is not."""
    bad = F.col("status") != "success"
    a = nodes.groupBy("entity").agg(F.max((bad & F.col("required")).cast("int")).alias("__r"), F.max((bad & ~F.col("required")).cast("int")).alias("__o"))
    return a.select("entity", F.when(F.col("__r") == 1, "failed").when(F.col("__o") == 1, "partial").otherwise("success").alias("status"))


def missing_signals(have: DataFrame, required: DataFrame) -> DataFrame:
    """entity, signal: required signals (business_type, signal) that an entity of that type lacks or that failed."""
    ok = have.where("status <> 'failed'").select("entity", "signal")
    want = have.select("entity", "business_type").distinct().join(F.broadcast(required), "business_type").select("entity", "signal")  # a few signals per type
    return want.join(ok, ["entity", "signal"], "left_anti")


def benchmark_snapshot(ranked: DataFrame, most: int = 3, weak: float = 40.0, strong: float = 60.0) -> DataFrame:
    """Per entity: its `most` weakest metrics below `weak` and strongest at or above `strong`, by percentile."""
    p = F.round("percentile", 9)
    low = F.row_number().over(Window.partitionBy("entity").orderBy(p, "metric"))
    high = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(p), "metric"))
    x = ranked.withColumns({"__l": low, "__h": high})
    side = F.when((F.col("percentile") < weak) & (F.col("__l") <= most), "weak").when((F.col("percentile") >= strong) & (F.col("__h") <= most), "strong")
    return x.withColumn("side", side).where("side is not null").select("entity", "metric", "percentile", "side")


def cohort_snapshot(summary: DataFrame) -> DataFrame:
    """Cohort signals, available only with a churn acceleration."""
    return summary.select("cohort_key", "decay", "churn_acceleration", F.col("churn_acceleration").isNotNull().alias("available"))


def scenario_snapshot(grid: DataFrame) -> DataFrame:
    """Best and worst growth and the base confidence of each entity."""
    pick = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    return grid.groupBy("entity").agg(pick("best", "projected_growth").alias("best_growth"), pick("worst", "projected_growth").alias("worst_growth"), pick("base", "confidence").alias("base_confidence"))


def insight_rows(series: DataFrame, keys=KEYS) -> DataFrame:
    """Per metric: last value, change on the one before, status, relative slope, variation and confidence.

    A change of more than 5% is growing or declining, none is unknown (no earlier
    value, or 0). Confidence is n / 12 (1 at most) less 0.3 x variation (0.3 at
    most), 0.1 at least; the slope is told from three values.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    known = series.where("value is not null")
    x = known.withColumns({"__p": F.lag("value").over(w), "__i": (F.row_number().over(w) - 1).cast("double")})
    a = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("value", "seq").alias("latest"), F.max_by("__p", "seq").alias("previous"),
        F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"), F.covar_pop("__i", "value").alias("__c"), F.var_pop("__i").alias("__v"),
    )
    tiny = F.abs("__m") < 1e-12
    change = F.when(F.col("previous") != 0, (F.col("latest") - F.col("previous")) / F.abs("previous"))
    slope = F.when(F.col("n") >= 3, F.col("__c") / F.col("__v") / F.when(tiny, 1.0).otherwise(F.abs("__m")))
    cv = F.when(F.col("n") >= 2, F.when(tiny, 0.0).otherwise(F.col("__s") / F.abs("__m")))
    a = a.withColumns({"change": change, "trend": slope, "cv": cv})
    status = F.when(F.col("change").isNull(), "unknown").when(F.col("change") > 0.05, "growing").when(F.col("change") < -0.05, "declining").otherwise("stable")
    label = F.when(F.col("cv").isNull(), "unknown").when(F.col("cv") > 0.30, "high").when(F.col("cv") > 0.10, "medium").otherwise("low")
    conf = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("n") / 12) - F.least(F.lit(0.3), 0.3 * F.coalesce("cv", F.lit(0.0))))
    return a.select(*keys, "n", "latest", "previous", "change", status.alias("status"), "trend", "cv", label.alias("volatility"), conf.alias("confidence"))
