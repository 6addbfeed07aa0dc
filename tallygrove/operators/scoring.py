"""Scores against peers, risk, root causes, segments and priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, bands, clip, deviation_pct, score_tier, sigmoid_100, zscore
from tallygrove.operators.order import with_ranks, with_totals

LOWER_IS_BETTER = "churn|cac|risk|cost"


def relative_scores(latest: DataFrame) -> DataFrame:
    """Each entity's metric against all others of that metric.

    latest: entity, metric, value, one row each. Moments of the others come from
    the group's sums less the own value; the median is the whole group's. No
    task holds all entities of a metric.
    """
    known = latest.where("value is not null")
    sums = known.groupBy("metric").agg(F.sum("value").alias("__all"), F.sum(F.col("value") * F.col("value")).alias("__all2"))
    x = with_ranks(known, ("metric",)).join(sums, "metric")
    x = x.withColumns({"__n": F.col("__n") - 1, "__s": F.col("__all") - F.col("value"), "__q": F.col("__all2") - F.col("value") * F.col("value")}).where("__n > 0")
    mean = F.col("__s") / F.col("__n")
    std = F.when(F.col("__n") < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.col("__q") / F.col("__n") - mean * mean, F.lit(0.0))))
    sign = F.when(F.lower("metric").rlike(LOWER_IS_BETTER), F.lit(-1.0)).otherwise(F.lit(1.0))
    out = x.withColumns({"benchmark_mean": mean, "benchmark_std": std}).withColumn("z", sign * zscore(F.col("value"), F.col("benchmark_mean"), F.col("benchmark_std")))
    share = F.col("__below") / F.col("__n") * 100
    out = out.withColumns({"score": sigmoid_100(F.col("z")), "percentile": F.when(sign < 0, 100 - share).otherwise(share), "deviation_pct": deviation_pct(F.col("value"), F.col("__median"))})
    return out.select("entity", "metric", "value", "benchmark_mean", "benchmark_std", "z", "score", "percentile", "deviation_pct", score_tier(F.col("score")).alias("tier"))


def confidence_weighted(scores: DataFrame, confidence: Column) -> DataFrame:
    """score pulled to 50 by what the confidence lacks."""
    c = clip(confidence, 0.0, 1.0)
    return scores.withColumn("confidence_score", 50 + (F.col("score") - 50) * c)


def macro_summary(scores: DataFrame, inflation: float, sensitivity: float = 1.0) -> DataFrame:
    """Nominal score, score of deflated values against deflated peers, their difference and the resilience to it."""
    real = sigmoid_100(zscore(F.col("value") / (1 + inflation), F.col("benchmark_mean") / (1 + inflation), F.col("benchmark_std")))
    out = scores.withColumn("real_score", real)
    delta = F.col("real_score") - F.col("score")
    return out.select("entity", "metric", F.col("score").alias("nominal_score"), "real_score", delta.alias("delta_due_to_macro"), clip(100 - F.abs(delta) * sensitivity, 0.0, 100.0).alias("macro_resilience"))


def stability_score(n: Column, std: Column, mean: Column) -> Column:
    """100 / (1 + cv); 50 below two points."""
    return F.when(n < 2, F.lit(50.0)).otherwise(100 / (1 + std / F.greatest(F.abs(mean), F.lit(GUARD))))


def composite(scores: DataFrame, series: DataFrame, confidence: float = 50.0) -> DataFrame:
    """Per entity: 0.4 growth + 0.3 level + 0.2 stability + 0.1 confidence, best and worst metric, market position."""
    level = scores.groupBy("entity").agg(
        F.avg("score").alias("level_score"), F.min_by("metric", F.struct(-F.round("score", 9), F.col("metric"))).alias("strongest"), F.min_by("metric", F.struct(F.round("score", 9), F.col("metric"))).alias("weakest")
    )
    rev = series.where("metric = 'recurring_revenue'")
    w = Window.partitionBy("entity").orderBy("seq")
    moves = rev.withColumn("__g", (F.col("value") - F.lag("value").over(w)) / F.greatest(F.abs(F.lag("value").over(w)), F.lit(GUARD)))
    per = moves.groupBy("entity").agg(
        stability_score(F.count("value"), F.stddev_pop("value"), F.avg("value")).alias("stability_score"), F.coalesce(F.max_by("__g", "seq"), F.lit(0.0)).alias("growth")
    )
    out = level.join(per, "entity").withColumn("growth_score", clip(50 + F.col("growth") * 100, 0.0, 100.0))
    total = 0.4 * F.col("growth_score") + 0.3 * F.col("level_score") + 0.2 * F.col("stability_score") + 0.1 * confidence
    return out.select("entity", "growth_score", "level_score", "stability_score", "strongest", "weakest", total.alias("overall_score"), market_position(total, F.col("growth_score"), F.col("stability_score")).alias("position"))


def market_position(overall: Column, growth: Column, stability: Column) -> Column:
    return (
        F.when((overall >= 65) & (growth >= 55), "Leader").when((overall <= 35) | (growth <= 40) & (overall <= 50), "Declining").when((growth >= 60) & (stability >= 40), "Challenger").otherwise("Stable")
    )


def category_mean(scores: DataFrame, categories: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the categories' mean scores; categories without a metric do not count."""
    cat = reduce(lambda acc, kv: F.when(F.col("metric") == kv[0], kv[1]).otherwise(acc), categories.items(), F.lit("other"))
    weight = reduce(lambda acc, kv: F.when(F.col("category") == kv[0], kv[1]).otherwise(acc), weights.items(), F.lit(1.0))
    per = scores.withColumn("category", cat).groupBy("entity", "category").agg(F.avg("score").alias("score"))
    return per.withColumn("w", weight).groupBy("entity").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("overall_score"))


def benchmark_metrics(frame: DataFrame) -> DataFrame:
    """entity, growth, revenue, risk -> growth index, share proxy, risk divergence, momentum class, against all others."""
    out = with_totals(frame, __n=F.count(F.lit(1)), __sg=F.sum("growth"), __sr=F.sum("risk"), __t=F.sum(F.greatest("revenue", F.lit(0.0))))
    others = lambda total, c: F.try_divide(F.col(total) - F.col(c), F.col("__n") - 1)
    out = out.withColumns({"__g": others("__sg", "growth"), "__r": others("__sr", "risk")})
    out = out.withColumns(
        {
            "relative_growth_index": F.try_divide(1 + F.col("growth"), 1 + F.col("__g")),
            "market_share_proxy": F.try_divide("revenue", "__t"),
            "risk_divergence": clip(50 + 50 * (F.col("__r") - F.col("risk")) / F.greatest(F.abs("__r"), F.lit(GUARD)), 0.0, 100.0),
        }
    )
    g, s, d = F.col("relative_growth_index"), F.col("market_share_proxy"), F.col("risk_divergence")
    momentum = F.when((g >= 1.05) & (s >= 0.05) & (d >= 50), "Leader").when(g >= 1.02, "Challenger").when((g < 0.95) | (d < 25), "Declining").otherwise("Stable")
    return out.select("entity", "relative_growth_index", "market_share_proxy", "risk_divergence", momentum.alias("momentum"))


def role_performance(roles: DataFrame, weights=(0.30, 0.25, 0.25, 0.20)) -> DataFrame:
    """role, growth, efficiency, variance, contribution -> score 0..100 of min-max parts; low variance is good."""
    inputs = {"growth": F.col("growth"), "efficiency": F.col("efficiency"), "variance": -F.col("variance"), "contribution": F.col("contribution")}
    ends = with_totals(roles, **{f"__{f.__name__}_{n}": f(x) for n, x in inputs.items() for f in (F.min, F.max)})

    def part(name: str, x: Column) -> Column:
        low, high = F.col(f"__min_{name}"), F.col(f"__max_{name}")
        return F.when(high - low <= GUARD, F.lit(50.0)).otherwise(F.try_divide(x - low, high - low) * 100)

    parts = [part(n, x) for n, x in inputs.items()]
    score = sum((k * p for k, p in zip(weights[1:], parts[1:], strict=True)), weights[0] * parts[0])
    return ends.withColumn("score", score).select(*roles.columns, "score").withColumn("tier", score_tier(F.col("score")))


# Risk.
RISK_WEIGHTS = {"revenue": 0.25, "churn": 0.25, "forecast": 0.20, "deviation": 0.15, "acceleration": 0.15}


def risk_score(growth: Column, churn: Column, slope: Column, deviation: Column, acceleration: Column, forecast: Column) -> Column:
    """Whole number 0..100, rounded half to even; without a forecast the two other signals count double."""
    percentage = lambda x: (x + 1) / 2
    positive = lambda x: clip(x, 0.0, 1.0)
    z = F.lit(0.0)
    used = lambda x: F.when(forecast, F.coalesce(x, z)).otherwise(z)
    w = RISK_WEIGHTS
    total = (
        w["revenue"] * percentage(-F.coalesce(growth, z)) + w["churn"] * percentage(F.coalesce(churn, z)) + w["forecast"] * positive(-used(slope))
        + w["deviation"] * positive(used(deviation)) + w["acceleration"] * positive(used(acceleration))
    )
    raw = F.bround(clip(total * 100, 0.0, 100.0), 0)
    return clip(F.when(forecast, raw).otherwise(raw / 0.5), 0.0, 100.0).cast("int")


def risk_level(score: Column) -> Column:
    return F.when(score <= 30, "low").when(score <= 60, "moderate").when(score <= 80, "high").otherwise("critical")


def risk_severity(score: Column) -> Column:
    return bands(score, [(80, "critical"), (60, "high"), (30, "moderate")], "low", strict=True)


# Root causes: rules in order, the first that holds is the primary issue.
def root_cause_rules(business_type: str) -> list[tuple[str, Column]]:
    c = F.col
    high = ("high_business_risk", c("risk_score") > 70)
    if business_type == "saas":
        return [
            ("retention_issue", (c("churn_delta") > 0) & (c("revenue_growth_delta") < 0)),
            ("acquisition_inefficiency", (c("cac_delta") > 0) & (c("revenue_growth_delta") <= 0)),
            ("customer_value_decline", (c("churn_delta") > 0) & (c("ltv_delta") < 0)),
            ("negative_growth_trend", (c("slope") < 0) & (c("deviation_percentage") < 0)),
            high,
        ]
    if business_type == "ecommerce":
        return [
            ("conversion_problem", (c("conversion_delta") < 0) & c("traffic_delta").between(-5, 5)),
            ("pricing_or_product_mix_issue", (c("aov_delta") < 0) & (c("revenue_growth_delta") < 0)),
            ("inefficient_marketing_spend", (c("cac_delta") > 0) & (c("conversion_delta") < 0)),
            ("retention_problem", c("repeat_purchase_delta") < 0),
            ("downward_sales_trend", c("slope") < 0),
            high,
        ]
    if business_type == "agency":
        return [
            ("client_retention_issue", c("churn_delta") > 0),
            ("underutilization_problem", c("utilization_delta") < 0),
            ("productivity_decline", c("revenue_per_employee_delta") < 0),
            ("capacity_misalignment", (c("revenue_growth_delta") < 0) & (c("utilization_delta") < 0)),
            ("future_revenue_risk", c("slope") < 0),
            high,
        ]
    raise ValueError(f"no root-cause rules for {business_type!r}")


def root_causes(df: DataFrame, business_type: str) -> DataFrame:
    """df's entity with issues (array), primary_issue, contributing (joined) and severity."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in root_cause_rules(business_type))))
    out = df.withColumn("issues", hits)
    return out.select(
        "entity", "issues", F.coalesce(F.try_element_at("issues", F.lit(1)), F.lit("no_issue_detected")).alias("primary_issue"),
        F.array_join(F.slice("issues", 2, 10), ",").alias("contributing"), risk_severity(F.col("risk_score")).alias("severity"),
    )


SEVERITIES = ("low", "moderate", "high", "critical")


def priority(*severities: Column, partial: Column | None = None) -> Column:
    """The gravest of several severities; low whenever the insight is partial."""
    place = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), c), F.lit(0))
    top = F.greatest(*map(place, severities), F.lit(1))
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), top.cast("int"))
    return name if partial is None else F.when(partial, "low").otherwise(name)


# Segments.
def segment_label(growth: Column, churn: Column, risk: Column) -> Column:
    return (
        F.when((growth > 0.10) & (churn <= 0.05) & (risk <= 0.30), "High Value / Growth Segment")
        .when((growth <= 0.0) & (churn > 0.10), "At Risk Segment")
        .when((growth < 0.0) & (risk > 0.60), "Declining Segment")
        .when(growth.between(0.0, 0.10) & (risk <= 0.60), "Stable Segment")
        .otherwise("Unclassified Segment")
    )


def standardized(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """features as z-scores by population deviation; nulls and NaN count as zero, constant columns stay zero."""
    clean = df.select(*(F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in df.columns))
    moments = clean.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = {c: F.when(F.col(f"s_{c}") > 1e-12, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(F.lit(0.0)) for c in features}
    return clean.crossJoin(F.broadcast(moments)).withColumns(scaled).select(*df.columns)  # one row of moments


def kmeans_segments(df: DataFrame, features: tuple[str, ...], k: int = 3, starts: int = 10, seed: int = 42) -> DataFrame:
    """df with cluster: the cheapest of `starts` seeded runs on standardised features."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    scaled = tuple(f"__z_{c}" for c in features)
    beside = standardized(df.withColumns({z: F.col(c) for z, c in zip(scaled, features, strict=True)}), scaled)
    points = VectorAssembler(inputCols=list(scaled), outputCol="__v").transform(beside).drop(*scaled)
    # Read by every iteration of every run, whose tasks each report to the driver: as many parts as cores, however many the shuffles made.
    kept = points.select("__v").repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="cluster", initMode="k-means||").fit(kept) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    kept.unpersist()
    return best.transform(points).drop("__v")
