"""KPI formulas, validity, payloads and unit economics as column expressions.

Every entity and month is computed in one job. The input is one row per window
with revenue, n_values, deviation (population), active, churned, previous, and
any extra inputs as columns; an extra that is absent counts as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, safe_divide
from tallygrove.operators.windows import along
from tallygrove.sources.packs import PACKS, Pack


def windows_of(months: DataFrame) -> DataFrame:
    """entity, month with revenue, n_values, active, churned and the previous month's revenue and churn."""
    w = Window.partitionBy("entity").orderBy("month")
    return months.select(
        "entity", "month", "revenue", F.col("orders").alias("n_values"), F.col("active").cast("double").alias("active"), F.col("churned").cast("double").alias("churned"),
        F.coalesce(F.lag("revenue").over(w), F.lit(0.0)).alias("previous"),
    )


def _saas(x: Callable[[str], Column]) -> dict[str, Column]:
    churn = safe_divide(x("churned"), x("active"))
    return {
        "mrr": x("revenue"),
        "churn_rate": churn,
        "ltv": F.try_divide(safe_divide(x("revenue"), x("active")) * F.coalesce(x("gross_margin"), F.lit(0.0)), churn),
        "growth_rate": safe_divide(x("revenue") - x("previous"), x("previous")),
    }


def _ecommerce(x):
    aov, frequency = safe_divide(x("revenue"), x("n_values")), safe_divide(x("n_values"), x("active"))
    return {
        "revenue": x("revenue"), "aov": aov, "conversion_rate": safe_divide(x("n_values"), x("total_visitors")), "cac": safe_divide(x("marketing_spend"), x("new_customers")),
        "purchase_frequency": frequency, "ltv": aov * frequency, "growth_rate": safe_divide(x("revenue") - x("previous"), x("previous")),
    }


def _agency(x):
    projects = F.coalesce(x("project_revenue"), F.lit(0.0))
    total = x("revenue") + projects
    return {
        "retainer_revenue": x("revenue"), "project_revenue": projects, "total_revenue": total, "client_churn": safe_divide(x("churned"), x("active")),
        "utilization_rate": safe_divide(x("billable_hours"), x("available_hours")), "revenue_per_employee": safe_divide(total, x("total_employees")),
        "client_ltv": safe_divide(x("revenue"), x("n_values")) * F.coalesce(x("average_client_lifespan_months"), F.lit(0.0)),
    }


def _financial(x):
    growth = safe_divide(x("revenue") - x("previous"), x("previous"))
    volatility = F.coalesce(x("volatility_override"), F.when(x("n_values") >= 2, x("deviation")))
    return {
        "market_revenue": x("revenue"), "account_churn": safe_divide(x("churned"), x("active")), "growth_rate": growth, "volatility": volatility,
        "sharpe_like": safe_divide(growth - x("risk_free_rate"), volatility),
    }


def _general(x):
    return {
        "timeseries_value": x("revenue"), "churn_rate": safe_divide(x("churned"), x("active")), "growth_rate": safe_divide(x("revenue") - x("previous"), x("previous")),
        "volatility": F.when(x("n_values") >= 2, x("deviation")), "target_attainment": safe_divide(x("revenue"), x("baseline_target")),
    }


def _healthcare(x):
    return {
        "patient_revenue": x("revenue"), "readmission_rate": safe_divide(x("churned"), x("active")), "growth_rate": safe_divide(x("revenue") - x("previous"), x("previous")),
        "bed_occupancy_rate": safe_divide(x("occupied_beds"), x("total_beds")), "revenue_per_staff_hour": safe_divide(x("revenue"), x("staff_hours")),
    }


def _marketing(x):
    return {
        "attributed_revenue": x("revenue"), "pipeline_churn": safe_divide(x("churned"), x("active")), "growth_rate": safe_divide(x("revenue") - x("previous"), x("previous")),
        "roas": safe_divide(x("revenue"), x("ad_spend")), "ctr": safe_divide(x("clicks"), x("impressions")), "cac": safe_divide(x("ad_spend"), x("active")),
    }


def _operations(x):
    return {
        "throughput": x("revenue"), "defect_rate": safe_divide(x("churned"), x("active")), "growth_rate": safe_divide(x("revenue") - x("previous"), x("previous")),
        "productivity": safe_divide(x("revenue"), x("labor_hours")), "uptime_rate": safe_divide(x("capacity_hours") - x("downtime_hours"), x("capacity_hours")),
    }


def _retail(x):
    return {
        "net_sales": x("revenue"), "customer_churn": safe_divide(x("churned"), x("active")), "growth_rate": safe_divide(x("revenue") - x("previous"), x("previous")),
        "conversion_rate": safe_divide(x("orders_in"), x("footfall")), "gross_margin_rate": safe_divide(x("revenue") - x("cogs"), x("revenue")),
        "average_ticket": safe_divide(x("revenue"), x("orders_in")),
    }


#: Business type -> formulas; a formula set takes a function from input name to column.
FORMULAS: dict[str, Callable[[Callable[[str], Column]], dict[str, Column]]] = {
    "saas": _saas, "ecommerce": _ecommerce, "agency": _agency, "financial_markets": _financial, "general_timeseries": _general,
    "healthcare": _healthcare, "marketing_analytics": _marketing, "operations": _operations, "retail": _retail,
}


def register_formula(business_type: str, formulas: Callable[[Callable[[str], Column]], dict[str, Column]]) -> None:
    """Adds a business type of your own."""
    FORMULAS[business_type] = formulas


def compute(df: DataFrame, business_type: str) -> DataFrame:
    """df with the metrics of the business type; inputs that df lacks count as null."""
    have = set(df.columns)
    x = lambda name: F.col(name).cast("double") if name in have else F.lit(None).cast("double")
    metrics = FORMULAS[business_type](x)
    keys = [c for c in ("entity", "month") if c in have]
    return df.select(*keys, *(c.alias(n) for n, c in metrics.items()))


def simple_kpis(df: DataFrame) -> DataFrame:
    """mrr, churn, growth and a lifetime value without margin: arpu / churn."""
    churn = safe_divide(F.col("churned"), F.col("active"))
    return df.select("entity", "month", F.col("revenue").alias("mrr"), churn.alias("churn_rate"),
                     F.try_divide(safe_divide(F.col("revenue"), F.col("active")), churn).alias("ltv"), safe_divide(F.col("revenue") - F.col("previous"), F.col("previous")).alias("growth_rate"))


def backfill(df: DataFrame, precomputed: DataFrame, pack: Pack) -> DataFrame:
    """Null metrics that the pack lists are taken from `precomputed` (entity, month, same names); adds source_<metric>."""
    other = precomputed.select("entity", "month", *(F.col(m).alias(f"__{m}") for m in pack.precomputed if m in precomputed.columns))
    out = df.join(other, ["entity", "month"], "left")
    for m in pack.precomputed:
        if m in df.columns and m in precomputed.columns:
            out = out.withColumn(f"source_{m}", F.when(F.col(m).isNotNull(), "formula").when(F.col(f"__{m}").isNotNull(), "precomputed")).withColumn(m, F.coalesce(m, f"__{m}")).drop(f"__{m}")
    return out


def payload(df: DataFrame, business_type: str, extras: tuple[str, ...] = ()) -> DataFrame:
    """entity, month, metric, value, unit, is_valid, error: a row per metric.

    A metric whose needed extra input is missing has insufficient_data; another
    null is a division_by_zero.
    """
    pack = PACKS[business_type]
    metrics = [c for c in df.columns if c not in ("entity", "month")]
    rows = F.array(*(
        F.struct(
            F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit("ratio" if m in pack.rates else "value").alias("unit"),
            F.lit(bool(set(pack.needs.get(m, ())) - set(extras))).alias("missing"),
        )
        for m in metrics
    ))
    flat = df.select("entity", "month", F.inline(rows))
    error = F.when(F.col("missing"), "insufficient_data").when(F.col("value").isNull(), "division_by_zero")
    return flat.select("entity", "month", "metric", F.when(~F.col("missing"), F.col("value")).alias("value"), "unit", error.isNull().alias("is_valid"), error.alias("error"))


def payload_map(rows: DataFrame) -> DataFrame:
    """entity, month, kpis: map from metric to its struct. A window has a fixed, small set of metrics."""
    entry = F.struct("metric", F.struct("value", "unit", "is_valid", "error"))
    return rows.groupBy("entity", "month").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("kpis"))


def payload_series(maps: DataFrame) -> DataFrame:
    """A payload map back to a series: entity, metric, seq, ts, value; invalid values are left out."""
    flat = maps.select("entity", F.col("month").alias("ts"), F.explode("kpis").alias("metric", "k")).where("k.value is not null")
    return flat.select("entity", "metric", (F.row_number().over(along(order="ts")) - 1).alias("seq"), "ts", F.col("k.value").alias("value"))


def sufficient_inputs(series: DataFrame, business_type: str) -> DataFrame:
    """Per entity: the pack's required inputs that no alias provides, by name, and whether all are there."""
    pack = PACKS[business_type]
    found = F.lit(None).cast("string")
    for canonical, names in pack.aliases().items():
        found = F.when(F.col("metric").isin(*names), canonical).otherwise(found)
    have = series.where("value is not null").withColumn("__c", found).groupBy("entity").agg(F.collect_set("__c").alias("__h"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, pack.required)), "__h"))
    return have.select("entity", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("sufficient"))


def recompute_mask(have: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entities whose stored digest or version is not the current one; others need no recomputation."""
    old = have.groupBy("entity").agg(F.min("digest").alias("__a"), F.max("digest").alias("__b"))
    return fresh.join(old, "entity", "left").where(F.col("__a").isNull() | (F.col("__a") != F.col("digest")) | (F.col("__b") != F.col("digest"))).select(*fresh.columns)


# Unit economics.
def unit_economics(df: DataFrame) -> DataFrame:
    """Ratios, trends, signals, summary and confidence from the last record of each entity.

    df: entity, month, ltv, cac, churn_rate, revenue, revenue_per_customer, growth_rate (any may be null).
    """
    w = Window.partitionBy("entity").orderBy("month")
    change = lambda c: F.when(F.abs(F.lag(c).over(w)) >= GUARD, (F.col(c) - F.lag(c).over(w)) / F.lag(c).over(w))
    marked = df.withColumns({f"{c}_trend": change(c) for c in ("ltv", "cac", "churn_rate")} | {"__r": F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("month")))})
    last = marked.where("__r = 1").drop("__r").withColumn("ltv_cac_ratio", F.when(F.abs("cac") >= GUARD, F.col("ltv") / F.col("cac")))
    signals = evaluate_signals()
    rank = lambda s: F.when(s["severity"] == "critical", 3).when(s["severity"] == "warning", 2).otherwise(1)
    core = sum((F.col(c).isNotNull().cast("int") for c in ("ltv", "cac", "ltv_cac_ratio", "churn_rate", "revenue_per_customer")), F.lit(0))
    has_trend = F.coalesce("ltv_trend", "cac_trend", "churn_rate_trend").isNotNull()
    out = last.withColumns({"signals": signals, "available": core})
    best = F.array_sort(F.transform("signals", lambda s, i: F.struct((-rank(s)).alias("a"), i.alias("b"), s["signal"].alias("signal"))))
    base = F.when(F.size("signals") > 0, F.array_min(F.transform("signals", lambda s: s["confidence"]))).otherwise(F.lit(0.5))
    confidence = base * F.col("available") / 5 * F.when(has_trend, 1.0).otherwise(0.9)
    enough = F.col("available") >= 2
    return out.select(
        "entity", "month", "ltv_cac_ratio", "ltv_trend", "cac_trend", "churn_rate_trend", "available",
        F.when(enough, F.array_join(F.transform("signals", lambda s: s["signal"]), ",")).otherwise("data_insufficient").alias("signals"),
        F.when(enough, F.coalesce(F.try_element_at(best, F.lit(1))["signal"], F.lit("no_signals"))).otherwise("data_insufficient").alias("summary"),
        F.when(enough, confidence).otherwise(F.lit(0.0)).alias("confidence"),
    )


def evaluate_signals(healthy: float = 3.0, critical: float = 1.0, churn_ok: float = 0.05, churn_crisis: float = 0.15, growing: float = 0.02, cac_rise: float = 0.1) -> Column:
    """Array of (signal, severity, confidence) that hold, in rule order; null inputs fire nothing."""
    ratio, churn, growth = F.col("ltv_cac_ratio"), F.col("churn_rate"), F.col("growth_rate")
    s = lambda name, severity, c: F.struct(F.lit(name).alias("signal"), F.lit(severity).alias("severity"), F.lit(c).alias("confidence"))
    attrition = F.coalesce(F.col("churn_rate_trend") > 0, F.lit(False))
    dearer = F.coalesce((F.col("cac_trend") > cac_rise) & (F.col("ltv_trend").isNull() | (F.col("ltv_trend") <= F.col("cac_trend"))), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(ratio < critical, s("acquisition_inefficiency", "critical", 0.95)).when(ratio < healthy, s("payback_risk", "warning", 0.8)).when(ratio >= healthy, s("unit_economics_healthy", "info", 0.9)),
            F.when(churn >= churn_crisis, s("churn_crisis", "critical", 0.9)),
            F.when((growth >= growing) & (attrition | dearer), s("unsustainable_growth", "warning", 0.8)),
            F.when((growth >= growing) & (churn <= churn_ok) & (ratio >= healthy), s("healthy_growth", "info", 0.9)),
        )
    )


def revenue_only_economics(series: DataFrame, implied: DataFrame, efficiency: DataFrame) -> DataFrame:
    """What revenue alone tells: implied churn, lifetime value, payback, burn signal; confidence x 0.7."""
    r = series.where("metric = 'recurring_revenue'").groupBy("entity").agg(F.max_by("value", "seq").alias("revenue"), F.avg("value").alias("__m"))
    out = r.join(implied.where("metric = 'recurring_revenue'").select("entity", "implied_churn"), "entity").join(
        efficiency.where("metric = 'recurring_revenue'").select("entity", "burn_risk", "velocity"), "entity"
    )
    ltv = F.when(F.col("implied_churn") > GUARD, F.col("revenue") / F.col("implied_churn"))
    burn = F.when(F.col("burn_risk") == "high", "burn_risk_elevated").when(F.col("burn_risk") == "moderate", "burn_risk_moderate")
    move = F.when(F.col("velocity") < -0.05, "revenue_contraction").when(F.col("velocity") > 0.05, "revenue_expansion")
    found = F.array_compact(F.array(burn, move))
    known = F.col("revenue").isNotNull().cast("int") + F.col("implied_churn").isNotNull().cast("int") + ltv.isNotNull().cast("int") + (F.col("__m") > GUARD).cast("int")
    return out.select(
        "entity", "revenue", "implied_churn", ltv.alias("ltv"), F.when(F.col("__m") > GUARD, F.col("revenue") / F.col("__m")).alias("payback"),
        F.array_join(found, ",").alias("signals"), (F.when(F.size(found) > 0, 0.5).otherwise(0.3) * F.least(F.lit(1.0), known / 5) * 0.7).alias("confidence"),
    )


# Business type from what the data hold.
def infer_category(series: DataFrame) -> DataFrame:
    """Per entity and pack: share of the pack's metric names present; the best pack, its score and the gap to the next.

    Packs are a dozen rows; the join is on the alias name.
    """
    from tallygrove.sources.packs import alias_table

    aliases = alias_table(series.sparkSession)
    size = aliases.groupBy("pack").agg(F.count_distinct("canonical").alias("__n"))
    have = series.select("entity", F.lower("metric").alias("alias")).distinct()
    hit = have.join(F.broadcast(aliases), "alias").groupBy("entity", "pack").agg(F.count_distinct("canonical").alias("__h"))  # a dozen packs
    scored = hit.join(F.broadcast(size), "pack").withColumn("score", F.col("__h") / F.col("__n"))  # a row per pack
    w = Window.partitionBy("entity").orderBy(F.desc("score"), "pack")
    ranked = scored.withColumns({"__r": F.row_number().over(w), "__next": F.lead("score").over(w)}).where("__r = 1")
    gap = F.col("score") - F.coalesce("__next", F.lit(0.0))
    final = F.col("score") - F.greatest(F.lit(0.0), 0.15 - gap)
    return ranked.select("entity", "pack", "score", gap.alias("gap"), final.alias("confidence"), F.when(final >= 0.8, "success").when(final >= 0.6, "ambiguous").otherwise("unknown").alias("status"))
