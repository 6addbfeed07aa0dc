"""Category packs: what a business type calls its metrics, what its formulas need.

A pack is configuration: it is read on the driver and reaches the data as a
small alias table or as column expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL_INPUTS = ("recurring_revenue", "active_customer_count", "churned_customer_count")


@dataclass(frozen=True)
class Pack:
    name: str
    revenue: tuple[str, ...]
    active: tuple[str, ...]
    churned: tuple[str, ...]
    categories: tuple[str, ...]
    rates: tuple[str, ...]
    optional: tuple[str, ...] = ()
    required: tuple[str, ...] = CANONICAL_INPUTS
    precomputed: tuple[str, ...] = ()
    #: metric -> extra inputs that it cannot do without
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def aliases(self) -> dict[str, tuple[str, ...]]:
        return dict(zip(CANONICAL_INPUTS, (self.revenue, self.active, self.churned), strict=True))


# Names that data of each business type uses.
PACKS: dict[str, Pack] = {
    p.name: p
    for p in (
        Pack("agency", ("recurring_revenue", "total_revenue"), ("active_customer_count", "active_clients"), ("churned_customer_count", "churned_clients"),
             ("sales", "agency"), ("client_churn", "utilization_rate"), ("utilization_rate", "revenue_per_employee", "client_ltv")),
        Pack("ecommerce", ("recurring_revenue", "revenue", "gmv"), ("active_customer_count", "active_customers"), ("churned_customer_count", "churned_customers", "lost_customers"),
             ("sales", "ecommerce"), ("conversion_rate", "purchase_frequency", "growth_rate"), ("aov", "cac", "purchase_frequency", "ltv", "growth_rate")),
        Pack("financial_markets", ("recurring_revenue", "market_revenue", "net_trading_income", "aum_revenue"), ("active_customer_count", "active_accounts", "active_investors"),
             ("churned_customer_count", "closed_accounts", "churned_accounts"), ("sales", "financial_markets", "markets"), ("account_churn", "growth_rate", "volatility", "sharpe_like"),
             ("volatility", "sharpe_like"), needs={"sharpe_like": ("risk_free_rate",)}),
        Pack("general_timeseries", ("recurring_revenue", "timeseries_value", "revenue", "value"), ("active_customer_count", "active_entities", "active_units"),
             ("churned_customer_count", "churned_entities", "lost_units"), ("sales", "general_timeseries", "generic_timeseries"), ("churn_rate", "growth_rate", "target_attainment"),
             ("volatility", "target_attainment"), required=("recurring_revenue",), needs={"target_attainment": ("baseline_target",)}),
        Pack("healthcare", ("recurring_revenue", "patient_revenue", "care_revenue", "service_revenue"), ("active_customer_count", "active_patients", "patient_count"),
             ("churned_customer_count", "readmissions", "churned_patients"), ("sales", "healthcare", "clinical"), ("readmission_rate", "growth_rate", "bed_occupancy_rate"),
             ("bed_occupancy_rate", "revenue_per_staff_hour"), needs={"bed_occupancy_rate": ("occupied_beds", "total_beds"), "revenue_per_staff_hour": ("staff_hours",)}),
        Pack("marketing_analytics", ("recurring_revenue", "attributed_revenue", "campaign_revenue", "marketing_revenue"), ("active_customer_count", "conversions", "converted_customers"),
             ("churned_customer_count", "lost_customers", "pipeline_dropoffs"), ("sales", "marketing", "marketing_analytics"), ("pipeline_churn", "growth_rate", "ctr"),
             ("roas", "ctr", "cac"), needs={"roas": ("ad_spend",), "ctr": ("impressions", "clicks"), "cac": ("ad_spend",)}),
        Pack("operations", ("recurring_revenue", "throughput", "output_value", "operating_output"), ("active_customer_count", "active_units", "processed_units"),
             ("churned_customer_count", "failed_units", "defect_units"), ("sales", "operations", "ops"), ("defect_rate", "growth_rate", "uptime_rate"),
             ("productivity", "uptime_rate"), needs={"productivity": ("labor_hours",), "uptime_rate": ("capacity_hours", "downtime_hours")}),
        Pack("retail", ("recurring_revenue", "net_sales", "retail_revenue", "pos_sales"), ("active_customer_count", "active_shoppers", "customers"),
             ("churned_customer_count", "churned_shoppers", "lost_shoppers"), ("sales", "retail", "storefront"), ("customer_churn", "growth_rate", "conversion_rate", "gross_margin_rate"),
             ("conversion_rate", "gross_margin_rate", "average_ticket"), needs={"conversion_rate": ("footfall", "orders_in"), "gross_margin_rate": ("cogs",), "average_ticket": ("orders_in",)}),
        Pack("saas", ("recurring_revenue", "mrr"), ("active_customer_count", "active_customers"), ("churned_customer_count", "churned_subscriptions", "churned_customers"),
             ("sales", "saas"), ("churn_rate", "growth_rate"), ("ltv", "growth_rate", "arpu"), precomputed=("churn_rate", "growth_rate", "ltv", "arpu")),
    )
}


def load_pack(text: str) -> Pack:
    """A pack from its JSON: name, aliases per canonical input, categories, rates, needs."""
    d = json.loads(text)
    alias = d.get("metric_aliases", {})
    names = [tuple(alias.get(k, (k,))) for k in CANONICAL_INPUTS]
    return Pack(d["name"], *names, tuple(d.get("category_aliases", ())), tuple(d.get("rate_metrics", ())), tuple(d.get("optional_signals", ())),
                tuple(d.get("required_inputs", CANONICAL_INPUTS)), tuple(d.get("precomputed_metrics", ())))


def alias_table(spark: SparkSession) -> DataFrame:
    """pack, canonical, alias: one row per name."""
    rows = [(p.name, canonical, a) for p in PACKS.values() for canonical, names in p.aliases().items() for a in names]
    return spark.createDataFrame(rows, "pack string, canonical string, alias string")


def primary_metric(business_type: str, fallback: str = "recurring_revenue") -> str:
    """The first revenue alias other than recurring_revenue."""
    pack = PACKS.get(business_type)
    return next((a for a in pack.revenue if a != "recurring_revenue"), fallback) if pack else fallback


def churn_metric(business_type: str, fallback: str = "churn_rate") -> str:
    """The first rate metric, by name, that speaks of churn."""
    pack = PACKS.get(business_type)
    return next((r for r in sorted(pack.rates) if "churn" in r), fallback) if pack else fallback


def strategy(df: DataFrame, category: str = "category") -> DataFrame:
    """The category itself if the data hold exactly one and it is a pack, else null."""
    one = df.agg(F.count_distinct(category).alias("__n"), F.min(category).alias("__c"))
    known = F.col("__c").isin(*PACKS)
    return one.select(F.when((F.col("__n") == 1) & known, F.col("__c")).alias("strategy"))
