"""Queries of the KPI formulas and unit economics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.operators import kpis as K
from tallygrove.operators import series as S
from tallygrove.plans.registry import on_monthly, on_series, register, rounded, with_monthly, with_series
from tallygrove.sources import packs, star
from tallygrove.sources.packs import PACKS

#: Extra inputs derived from each window, so that every formula has something to work on; both engines take them.
EXTRAS = {
    "gross_margin": "0.7",
    "total_visitors": "n_values * 10",
    "marketing_spend": "revenue * 0.1",
    "new_customers": "active / 2.0",
    "project_revenue": "revenue * 0.25",
    "billable_hours": "active * 20",
    "available_hours": "active * 32",
    "total_employees": "active / 4.0",
    "average_client_lifespan_months": "18.0",
    "deviation": "revenue / 8",
    "risk_free_rate": "0.05",
    "baseline_target": "1e6",
    "occupied_beds": "active",
    "total_beds": "active + churned",
    "staff_hours": "active * 40",
    "ad_spend": "revenue * 0.2",
    "impressions": "n_values * 1000",
    "clicks": "n_values * 31",
    "labor_hours": "active * 160",
    "downtime_hours": "churned",
    "capacity_hours": "active * 4",
    "footfall": "n_values * 7",
    "orders_in": "n_values",
    "cogs": "revenue * 0.6",
}

_WIN = (
    """
, win0 AS (SELECT entity, month, revenue, orders::DOUBLE AS n_values, active::DOUBLE AS active, churned::DOUBLE AS churned, coalesce(lag(revenue) OVER (PARTITION BY entity ORDER BY month), 0) AS previous FROM monthly)
, win AS (SELECT *, """
    + ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in EXTRAS.items())
    + " FROM win0)"
)
_GROWTH = "(revenue - previous) / nullif(previous, 0) AS growth_rate"
_CHURN = "churned / nullif(active, 0)"

#: The same formulas in SQL.
FORMULA_SQL = {
    "saas": f"revenue AS mrr, {_CHURN} AS churn_rate, revenue / nullif(active, 0) * gross_margin / nullif({_CHURN}, 0) AS ltv, {_GROWTH}",
    "ecommerce": f"revenue AS revenue, revenue / nullif(n_values, 0) AS aov, n_values / nullif(total_visitors, 0) AS conversion_rate, marketing_spend / nullif(new_customers, 0) AS cac, "
    f"n_values / nullif(active, 0) AS purchase_frequency, revenue / nullif(n_values, 0) * (n_values / nullif(active, 0)) AS ltv, {_GROWTH}",
    "agency": f"revenue AS retainer_revenue, project_revenue, revenue + project_revenue AS total_revenue, {_CHURN} AS client_churn, billable_hours / nullif(available_hours, 0) AS utilization_rate, "
    "(revenue + project_revenue) / nullif(total_employees, 0) AS revenue_per_employee, revenue / nullif(n_values, 0) * average_client_lifespan_months AS client_ltv",
    "financial_markets": f"revenue AS market_revenue, {_CHURN} AS account_churn, {_GROWTH}, CASE WHEN n_values >= 2 THEN deviation END AS volatility, "
    "((revenue - previous) / nullif(previous, 0) - risk_free_rate) / nullif(CASE WHEN n_values >= 2 THEN deviation END, 0) AS sharpe_like",
    "general_timeseries": f"revenue AS timeseries_value, {_CHURN} AS churn_rate, {_GROWTH}, CASE WHEN n_values >= 2 THEN deviation END AS volatility, revenue / baseline_target AS target_attainment",
    "healthcare": f"revenue AS patient_revenue, {_CHURN} AS readmission_rate, {_GROWTH}, occupied_beds / nullif(total_beds, 0) AS bed_occupancy_rate, revenue / nullif(staff_hours, 0) AS revenue_per_staff_hour",
    "marketing_analytics": f"revenue AS attributed_revenue, {_CHURN} AS pipeline_churn, {_GROWTH}, revenue / nullif(ad_spend, 0) AS roas, clicks / nullif(impressions, 0) AS ctr, ad_spend / nullif(active, 0) AS cac",
    "operations": f"revenue AS throughput, {_CHURN} AS defect_rate, {_GROWTH}, revenue / nullif(labor_hours, 0) AS productivity, (capacity_hours - downtime_hours) / nullif(capacity_hours, 0) AS uptime_rate",
    "retail": f"revenue AS net_sales, {_CHURN} AS customer_churn, {_GROWTH}, orders_in / nullif(footfall, 0) AS conversion_rate, (revenue - cogs) / nullif(revenue, 0) AS gross_margin_rate, revenue / nullif(orders_in, 0) AS average_ticket",
}


def inputs(months):
    return K.windows_of(months).withColumns({n: F.expr(sql).cast("double") for n, sql in EXTRAS.items()})


def _rounded_sql(body: str) -> str:
    return f"SELECT entity, month, round(COLUMNS(* EXCLUDE (entity, month)), 4) FROM (SELECT entity, month, {body} FROM win)"


def _money(df):
    """Amounts and rates of one window, to four decimals."""
    return rounded(df, 4)


for _type in K.FORMULAS:
    register(f"kpi_{_type}", on_monthly(lambda m, t=_type: _money(K.compute(inputs(m), t))), with_monthly(_WIN + "\n" + _rounded_sql(FORMULA_SQL[_type])))


def entity_monthly_kpi(spark, sf_dir):
    """Revenue, customers, churn, lifetime value and growth of every entity and month."""
    months = star.monthly(star.facts(spark, sf_dir))
    return _money(K.compute(inputs(months), "saas").join(months.select("entity", "month", "active", "churned"), ["entity", "month"]))


register(
    "entity_monthly_kpi",
    entity_monthly_kpi,
    with_monthly(_WIN + f"""
SELECT entity, month, round(mrr, 4) AS mrr, round(churn_rate, 4) AS churn_rate, round(ltv, 4) AS ltv, round(growth_rate, 4) AS growth_rate, active, churned
FROM (SELECT entity, month, {FORMULA_SQL['saas']} FROM win) JOIN (SELECT entity, month, active, churned FROM monthly) USING (entity, month)"""),
)
register(
    "kpi_simple",
    on_monthly(lambda m: _money(K.simple_kpis(inputs(m)))),
    with_monthly(_WIN + "\n" + _rounded_sql(f"revenue AS mrr, {_CHURN} AS churn_rate, revenue / nullif(active, 0) / nullif({_CHURN}, 0) AS ltv, {_GROWTH}")),
)
_ROWS = f"""
, k AS (SELECT entity, month, {FORMULA_SQL['saas']} FROM win)
, rows AS (
  SELECT entity, month, 'mrr' AS metric, mrr AS value, 'value' AS unit FROM k UNION ALL SELECT entity, month, 'churn_rate', churn_rate, 'ratio' FROM k
  UNION ALL SELECT entity, month, 'ltv', ltv, 'value' FROM k UNION ALL SELECT entity, month, 'growth_rate', growth_rate, 'ratio' FROM k)"""
register(
    "kpi_payload_rows",
    on_monthly(lambda m: _money(K.payload(K.compute(inputs(m), "saas"), "saas"))),
    with_monthly(_WIN + _ROWS + "\nSELECT entity, month, metric, round(value, 4) AS value, unit, value IS NOT NULL AS is_valid, CASE WHEN value IS NULL THEN 'division_by_zero' END AS error FROM rows"),
)
register(
    "kpi_validity_missing_inputs",
    on_monthly(lambda m: _money(K.payload(K.compute(K.windows_of(m), "retail"), "retail").groupBy("metric", "error").agg(F.count(F.lit(1)).alias("n")))),
    with_monthly(_WIN + """
, k AS (SELECT revenue AS net_sales, churned / nullif(active, 0) AS customer_churn, (revenue - previous) / nullif(previous, 0) AS growth_rate FROM win)
, r AS (SELECT 'net_sales' AS metric, CASE WHEN net_sales IS NULL THEN 'division_by_zero' END AS error FROM k UNION ALL SELECT 'customer_churn', CASE WHEN customer_churn IS NULL THEN 'division_by_zero' END FROM k
  UNION ALL SELECT 'growth_rate', CASE WHEN growth_rate IS NULL THEN 'division_by_zero' END FROM k UNION ALL SELECT m, 'insufficient_data' FROM k, (VALUES ('conversion_rate'), ('gross_margin_rate'), ('average_ticket')) t(m))
SELECT metric, error, count(*) AS n FROM r GROUP BY ALL"""),
)
register(
    "kpi_payload_series",
    on_monthly(lambda m: K.payload_series(K.payload_map(K.payload(K.compute(inputs(m), "saas"), "saas"))).select("entity", "metric", "seq", "ts", (F.round(F.col("value") * 1e4) / 1e4).alias("value"))),
    with_monthly(_WIN + _ROWS + "\nSELECT entity, metric, row_number() OVER (PARTITION BY entity, metric ORDER BY month) - 1 AS seq, month AS ts, round(value, 4) AS value FROM rows WHERE value IS NOT NULL"),
)
register(
    "kpi_backfill_precomputed",
    on_monthly(lambda m: _money(K.backfill(
        K.compute(K.windows_of(m).withColumn("gross_margin", F.lit(0.5)), "saas"),
        m.select("entity", "month", F.lit(0.25).alias("churn_rate"), F.lit(0.0).alias("growth_rate"), F.lit(1.0).alias("ltv")), PACKS["saas"],
    ).select("entity", "month", "churn_rate", "growth_rate", "ltv", "source_churn_rate", "source_growth_rate", "source_ltv"))),
    with_monthly(_WIN + f"""
, k AS (SELECT entity, month, {_CHURN} AS c, (revenue - previous) / nullif(previous, 0) AS g, revenue / nullif(active, 0) * 0.5::DOUBLE / nullif({_CHURN}, 0) AS l FROM win)
SELECT entity, month, round(coalesce(c, 0.25::DOUBLE), 4) AS churn_rate, round(coalesce(g, 0::DOUBLE), 4) AS growth_rate, round(coalesce(l, 1::DOUBLE), 4) AS ltv,
  CASE WHEN c IS NULL THEN 'precomputed' ELSE 'formula' END AS source_churn_rate, CASE WHEN g IS NULL THEN 'precomputed' ELSE 'formula' END AS source_growth_rate,
  CASE WHEN l IS NULL THEN 'precomputed' ELSE 'formula' END AS source_ltv FROM k"""),
)


def _some_inputs(s):
    """The order count stands for churned customers; entities lack one or both of the others by their number."""
    k = F.substring("entity", 8, 10).cast("int") % 4
    name = F.when(F.col("metric") == "order_count", "churned_customer_count").otherwise(F.col("metric"))
    return s.withColumn("metric", name).where(~((F.col("metric") == "recurring_revenue") & k.isin(1, 3)) & ~((F.col("metric") == "churned_customer_count") & k.isin(2, 3)))


register(
    "kpi_input_sufficiency",
    on_series(lambda s: K.sufficient_inputs(_some_inputs(s), "saas")),
    with_series("""
, e AS (SELECT DISTINCT entity, CAST(substr(entity, 8) AS INT) % 4 AS k FROM series)
SELECT entity, CASE k WHEN 1 THEN 'recurring_revenue' WHEN 2 THEN 'churned_customer_count' WHEN 3 THEN 'churned_customer_count,recurring_revenue' ELSE '' END AS missing, k = 0 AS sufficient FROM e"""),
)


def _economics(m):
    k = K.compute(inputs(m), "saas")
    return K.unit_economics(k.join(inputs(m).select("entity", "month", (F.col("marketing_spend") / F.col("new_customers")).alias("cac"), (F.col("revenue") / F.col("active")).alias("revenue_per_customer")), ["entity", "month"])
                            .select("entity", "month", "ltv", "cac", "churn_rate", F.col("mrr").alias("revenue"), "revenue_per_customer", "growth_rate"))


_UE = f"""
, k AS (SELECT entity, month, {FORMULA_SQL['saas']}, marketing_spend / nullif(new_customers, 0) AS cac, revenue / nullif(active, 0) AS rpc FROM win)
, t AS (SELECT *, CASE WHEN abs(lag(ltv) OVER w) >= 1e-9 THEN (ltv - lag(ltv) OVER w) / lag(ltv) OVER w END AS lt, CASE WHEN abs(lag(cac) OVER w) >= 1e-9 THEN (cac - lag(cac) OVER w) / lag(cac) OVER w END AS ct,
    CASE WHEN abs(lag(churn_rate) OVER w) >= 1e-9 THEN (churn_rate - lag(churn_rate) OVER w) / lag(churn_rate) OVER w END AS ht FROM k WINDOW w AS (PARTITION BY entity ORDER BY month))
, l AS (SELECT *, CASE WHEN abs(cac) >= 1e-9 THEN ltv / cac END AS ratio FROM t QUALIFY row_number() OVER (PARTITION BY entity ORDER BY month DESC) = 1)
, s AS (
  SELECT *, (ltv IS NOT NULL)::INT + (cac IS NOT NULL)::INT + (ratio IS NOT NULL)::INT + (churn_rate IS NOT NULL)::INT + (rpc IS NOT NULL)::INT AS available,
    CASE WHEN ratio < 1 THEN 'acquisition_inefficiency' WHEN ratio < 3 THEN 'payback_risk' WHEN ratio >= 3 THEN 'unit_economics_healthy' END AS s1,
    CASE WHEN churn_rate >= 0.15 THEN 'churn_crisis' END AS s2,
    CASE WHEN growth_rate >= 0.02 AND (coalesce(ht > 0, false) OR coalesce(ct > 0.1 AND (lt IS NULL OR lt <= ct), false)) THEN 'unsustainable_growth' END AS s3,
    CASE WHEN growth_rate >= 0.02 AND churn_rate <= 0.05 AND ratio >= 3 THEN 'healthy_growth' END AS s4 FROM l)
SELECT entity, month, round(ratio, 6) AS ltv_cac_ratio, round(lt, 6) AS ltv_trend, round(ct, 6) AS cac_trend, round(ht, 6) AS churn_rate_trend, available,
  CASE WHEN available < 2 THEN 'data_insufficient' ELSE concat_ws(',', s1, s2, s3, s4) END AS signals,
  CASE WHEN available < 2 THEN 'data_insufficient' WHEN s1 = 'acquisition_inefficiency' THEN s1 WHEN s2 IS NOT NULL THEN s2 WHEN s1 = 'payback_risk' THEN s1 WHEN s3 IS NOT NULL THEN s3 ELSE coalesce(s1, s4, 'no_signals') END AS summary,
  round(CASE WHEN available < 2 THEN 0 ELSE coalesce(least(CASE s1 WHEN 'acquisition_inefficiency' THEN 0.95 WHEN 'payback_risk' THEN 0.8 WHEN 'unit_economics_healthy' THEN 0.9 END,
    CASE WHEN s2 IS NOT NULL THEN 0.9 END, CASE WHEN s3 IS NOT NULL THEN 0.8 END, CASE WHEN s4 IS NOT NULL THEN 0.9 END), 0.5) * available / 5.0 * CASE WHEN coalesce(lt, ct, ht) IS NOT NULL THEN 1 ELSE 0.9 END END, 6)::DOUBLE AS confidence FROM s"""
register("unit_economics", on_monthly(_economics), with_monthly(_WIN + _UE))
register("unit_economics_revenue_only", on_series(lambda s: K.revenue_only_economics(s, S.implied_churn(s), S.growth_efficiency(s))))
register("category_inference", on_series(K.infer_category))
register(
    "category_strategy",
    lambda spark, d: packs.strategy(star.facts(spark, d).withColumn("category", F.lit("saas"))),
    "SELECT 'saas' AS strategy",
)
