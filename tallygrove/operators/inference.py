"""Which business type a dataset is of, from metric names, vocabulary and shape.

Datasets are many and names are few: each dataset carries an array of its
metric and column names, and the nine packs are literals beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.likeness import likeness
from tallygrove.sources.packs import PACKS

# Metrics that are typical of a business type.
CORE: dict[str, tuple[str, ...]] = {
    "agency": ("billable_hours", "utilization", "utilization_rate", "team_performance", "project_revenue", "billable_rate", "non_billable_hours", "client_satisfaction"),
    "ecommerce": ("aov", "cart_abandonment", "roas", "conversion_rate", "gmv", "orders", "purchase_frequency", "cac", "revenue", "active_customers", "new_customers"),
    "financial_markets": ("close_price", "volume", "drawdown", "volatility", "sharpe_like", "aum_revenue", "net_trading_income", "active_accounts", "risk_free_rate", "pnl"),
    "general_timeseries": ("revenue", "value", "count", "total"),
    "healthcare": ("readmission_rate", "occupancy_rate", "bed_occupancy_rate", "patient_revenue", "active_patients", "readmissions", "occupied_beds", "total_beds", "staff_hours", "care_revenue"),
    "marketing_analytics": ("impressions", "clicks", "ctr", "cpc", "ad_spend", "roas", "conversions", "campaign_revenue", "attributed_revenue", "pipeline_dropoffs"),
    "operations": ("throughput", "defect_rate", "uptime_rate", "output_value", "labor_hours", "downtime_hours", "capacity_hours", "failed_units", "processed_units"),
    "retail": ("net_sales", "footfall", "average_ticket", "gross_margin_rate", "pos_sales", "active_shoppers", "cogs", "conversion_rate", "retail_revenue"),
    "saas": ("mrr", "arr", "churn_rate", "ltv", "cac", "recurring_revenue", "active_subscriptions", "churned_subscriptions", "arpu", "expansion_revenue", "contraction_revenue"),
}
# Column names that tell of time, segments and transactions.
TIME = ("date", "timestamp", "time", "period", "month", "year", "quarter", "week", "day", "created_at", "updated_at", "report_date")
SEGMENT = ("role", "segment", "department", "team", "region", "channel", "tier", "plan", "cohort", "group", "division")
TRANSACTION = ("order_id", "transaction_id", "invoice_id", "payment_id", "cart_id", "checkout_id", "sku", "product_id", "item_id")
#: Score of a time, segment and transaction column, and of its absence, per business type.
SHAPE = {
    "saas": ((0.8, 0.1), (0.5, 0.3), (0.3, 0.2)), "financial_markets": ((0.8, 0.1), (0.5, 0.3), (0.3, 0.2)), "general_timeseries": ((0.8, 0.1), (0.5, 0.3), (0.3, 0.2)),
    "ecommerce": ((0.5, 0.2), (0.3, 0.2), (0.7, 0.3)), "retail": ((0.5, 0.2), (0.3, 0.2), (0.7, 0.3)), "healthcare": ((0.6, 0.2), (0.6, 0.2), (0.3, 0.2)),
    "marketing_analytics": ((0.5, 0.2), (0.5, 0.2), (0.4, 0.3)), "agency": ((0.5, 0.2), (0.7, 0.2), (0.3, 0.2)), "operations": ((0.6, 0.2), (0.4, 0.2), (0.4, 0.3)),
}


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def metric_score(metrics: Column, core: tuple[str, ...]) -> Column:
    """Core metrics met (a name within the other counts) over the shorter list; more from three and from five."""
    hits = F.size(F.filter(F.array(*map(F.lit, core)), lambda c: F.exists(metrics, lambda m: m.contains(c) | c.contains(m))))
    base = F.coalesce(F.try_divide(hits.cast("double"), F.least(F.lit(len(core)), F.size(metrics))), F.lit(0.0))
    return F.least(F.lit(1.0), base * F.when(hits >= 5, 1.3).when(hits >= 3, 1.15).otherwise(1.0))


def _terms(kind: str) -> list[str]:
    p = PACKS[kind]
    names = {n for k, v in p.aliases().items() for n in (k, *v)} | set(p.categories) | set(p.optional) | set(p.rates) | set(CORE[kind])
    return sorted(names)


def semantic_score(terms: Column, kind: str, least: float = 0.75) -> Column:
    """Share of the pack's vocabulary that some term of the dataset is like, from a likeness of `least` on."""
    near = lambda a, b: likeness(a, b) >= least
    want = F.array(*map(F.lit, _terms(kind)))
    return F.size(F.filter(want, lambda t: F.exists(terms, lambda d: near(d, t)))) / float(len(_terms(kind)))


def shape_score(columns: Column, rows: Column, kind: str) -> Column:
    has = lambda names: F.arrays_overlap(columns, F.array(*map(F.lit, names)))
    parts = [F.when(has(n), yes).otherwise(no) for n, (yes, no) in zip((TIME, SEGMENT, TRANSACTION), SHAPE[kind], strict=True)]
    parts.append(F.when(rows > 100, 0.5).when(rows > 20, 0.3).otherwise(0.1))
    return sum(parts[1:], parts[0]) / 4


def category_scores(datasets: DataFrame) -> DataFrame:
    """dataset, category, metric, semantic, shape, score: a row per dataset and business type.

    datasets: dataset, metrics, columns (arrays of names), rows. The metric score
    weighs more once it is at 0.8.
    """
    d = datasets.select("dataset", "rows", *(F.array_distinct(F.transform(c, plain_name)).alias(c) for c in ("metrics", "columns"))).withColumn("__t", F.array_union("metrics", "columns"))
    each = F.array(*(
        F.struct(F.lit(k).alias("category"), metric_score(F.col("metrics"), CORE[k]).alias("metric"), semantic_score(F.col("__t"), k).alias("semantic"), shape_score(F.col("columns"), F.col("rows"), k).alias("shape"))
        for k in sorted(PACKS)
    ))
    flat = d.select("dataset", F.inline(each))
    strong = F.col("metric") >= 0.8
    score = F.when(strong, 0.70 * F.col("metric") + 0.15 * F.col("semantic") + 0.15 * F.col("shape")).otherwise(0.5 * F.col("metric") + 0.3 * F.col("semantic") + 0.2 * F.col("shape"))
    return flat.withColumn("score", score)


def infer(datasets: DataFrame) -> DataFrame:
    """dataset, category, confidence, status: the best type, less up to 0.15 if the next is close."""
    s = category_scores(datasets)
    w = Window.partitionBy("dataset").orderBy(F.desc(F.round("score", 9)), "category")
    top = s.withColumns({"__r": F.row_number().over(w), "__n": F.lead("score").over(w)}).where("__r = 1")
    conf = F.greatest(F.lit(0.0), F.col("score") - F.greatest(F.lit(0.0), 0.15 - (F.col("score") - F.coalesce("__n", F.lit(0.0)))))
    out = top.withColumn("confidence", conf)
    status = F.when(F.col("confidence") >= 0.8, "success").when(F.col("confidence") >= 0.6, "ambiguous").otherwise("insufficient_data")
    return out.select("dataset", F.when(F.col("confidence") >= 0.6, F.col("category")).alias("category"), "confidence", status.alias("status"))
