"""Scans of the fact table that the analyses start from: filters, metadata fields, bands.

The scans of dimensions, cohorts and macro rows take the closed interval
[start, end]; sums elsewhere are half-open. Filters are on plain columns, so
they reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.operators.aggregates import in_period
from tallygrove.sources.packs import PACKS

#: Metadata keys that may hold a size band, first one first.
BAND_KEYS = ("size_band", "company_size_band", "employee_size_band", "org_size_band", "firm_size_band")


def meta(key: str, column: str = "metadata") -> Column:
    """A metadata field, null if blank."""
    return F.nullif(F.trim(F.get_json_object(column, f"$.{key}")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def base_rows(facts: DataFrame, business_type: str, start: Column, end: Column, entity: str | None = None, closed: bool = False) -> DataFrame:
    """Rows of a business type's categories in the period, of one entity or of all."""
    rows = facts.where(F.col("category").isin(*PACKS[business_type].categories) & in_period(F.col("ts"), start, end, closed))
    return rows if entity is None else rows.where(F.col("entity") == entity)


def dimension_rows(facts: DataFrame, business_type: str, start: Column, end: Column) -> DataFrame:
    """Revenue rows with team, channel and product line from the metadata; rows without a number are left out."""
    rows = base_rows(facts, business_type, start, end, closed=True).where(F.col("metric").isin(*PACKS[business_type].revenue) & F.col("value").isNotNull())
    return rows.select("entity", "role", "region", "source_type", "metric", "value", "ts", *(meta(k).alias(k) for k in ("team", "channel", "product_line")))


def cohort_rows(facts: DataFrame, business_type: str, start: Column, end: Column, lookback_days: int = 365) -> DataFrame:
    """Rows from a year before the period on, with the cohort fields and their fallbacks."""
    rows = base_rows(facts, business_type, start - F.expr(f"interval {lookback_days} days"), end, closed=True).where("value is not null")
    return rows.select(
        "entity", "metric", "value", "ts", meta("signup_month").alias("signup_month"),
        F.coalesce(meta("acquisition_channel"), meta("channel")).alias("acquisition_channel"), F.coalesce(meta("segment"), meta("customer_segment")).alias("segment"),
    )


def macro_rows(facts: DataFrame, start: Column, end: Column, lookback_days: int = 730) -> DataFrame:
    """Macro rows from two years before the period on."""
    return facts.where((F.col("category") == "macro") & in_period(F.col("ts"), start - F.expr(f"interval {lookback_days} days"), end, closed=True))


def row_band(column: str = "metadata") -> Column:
    return F.lower(F.coalesce(*(meta(k, column) for k in BAND_KEYS)))


def entity_band(rows: DataFrame, newest: int = 500) -> DataFrame:
    """entity, band: the newest band within an entity's newest rows."""
    w = Window.partitionBy("entity").orderBy(F.desc("ts"), F.desc("id"))
    head = rows.select("entity", "ts", "id", row_band().alias("band")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= newest)
    return head.groupBy("entity").agg(F.min_by("band", F.when(F.col("band").isNotNull(), F.col("__r"))).alias("band"))


def peer_rows(facts: DataFrame, business_type: str, entity: str, start: Column, end: Column) -> DataFrame:
    """Rows of the other entities in the period; those of the entity's size band if it has one and any match."""
    rows = base_rows(facts, business_type, start, end, closed=True)
    own = entity_band(rows.where(F.col("entity") == entity)).select(F.col("band").alias("__own"))
    others = rows.where(F.col("entity") != entity).withColumn("band", row_band())
    client = others.crossJoin(F.broadcast(own.groupBy().agg(F.max("__own").alias("__own"))))  # one row
    some = client.groupBy().agg(F.max((F.col("band") == F.col("__own")).cast("int")).alias("__any"))
    both = client.crossJoin(F.broadcast(some))  # one row
    return both.where((F.coalesce("__any", F.lit(0)) == 0) | (F.col("band") == F.col("__own"))).drop("__own", "__any")


def metric_kind(metric: Column, active: tuple[str, ...] = (), churned: tuple[str, ...] = ()) -> Column:
    """retention, churn, active or other: by explicit names first, then by what the name holds."""
    m = F.lower(F.trim(metric))
    kind = F.when(m.isin(*active), "active") if active else F.when(F.lit(False), "active")
    kind = kind.when(m.isin(*churned), "churn") if churned else kind
    return kind.when(m.contains("retention"), "retention").when(m.rlike("churn|lost"), "churn").when(m.startswith("active_"), "active").otherwise("other")


def period_bounds(windows: DataFrame, days: int = 90) -> DataFrame:
    """entity, start, end: the window with the greatest end; without a start, the last 90 days."""
    last = windows.groupBy("entity").agg(F.max_by("period_start", "period_end").alias("start"), F.max("period_end").alias("end"))
    return last.withColumn("start", F.coalesce("start", F.date_sub("end", days)))


def signal_deltas(series: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Per entity: growth, churn and conversion changes with defaults of 0, and how many were missing.

    A direct signal wins over the growth rate, which wins over the change of the
    first revenue metric.
    """
    w = Window.partitionBy("entity", "metric").orderBy("seq")
    change = F.try_divide(F.col("value") - F.lag("value").over(w), F.abs(F.lag("value").over(w)))
    back = F.row_number().over(Window.partitionBy("entity", "metric").orderBy(F.desc("seq")))
    last = series.withColumns({"__c": change, "__b": back}).where("__b = 1")
    pick = lambda *names: F.coalesce(*(F.max(F.when(F.col("metric") == n, F.col("__c"))) for n in names))
    level = lambda n: F.max(F.when(F.col("metric") == n, F.col("value")))
    out = last.groupBy("entity").agg(
        F.coalesce(level("growth_rate"), pick("recurring_revenue", "revenue", "mrr")).alias("__g"), pick("churn_rate", "churned_customer_count").alias("__h"), pick("conversion_rate").alias("__v")
    )
    if direct is not None:
        d = direct.groupBy("entity").agg(F.max(F.when(F.col("signal") == "revenue_growth_delta", F.col("value"))).alias("__d"))
        out = out.join(d, "entity", "left").withColumn("__g", F.coalesce("__d", "__g")).drop("__d")
    missing = sum((F.col(c).isNull().cast("int") for c in ("__g", "__h", "__v")), F.lit(0))
    zero = F.lit(0.0)
    return out.select("entity", F.coalesce("__g", zero).alias("revenue_growth_delta"), F.coalesce("__h", zero).alias("churn_delta"), F.coalesce("__v", zero).alias("conversion_delta"), missing.alias("missing"))


def primary_metric_of(series: DataFrame, candidates: tuple[str, ...]) -> DataFrame:
    """Per entity: the first candidate it has, else its deepest metric, then by name."""
    depth = series.groupBy("entity", "metric").agg(F.count("value").alias("__n"))
    place = F.lit(len(candidates))
    for i, c in reversed(list(enumerate(candidates))):
        place = F.when(F.col("metric") == c, i).otherwise(place)
    w = Window.partitionBy("entity").orderBy(place, F.desc("__n"), "metric")
    return depth.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("entity", "metric")


def revenue_trend(series: DataFrame, candidates: tuple[str, ...] = ("recurring_revenue", "revenue", "mrr", "total_revenue")) -> DataFrame:
    """entity, ts, revenue: the first revenue metric, in a fixed order, that an entity has."""
    return series.where(F.col("metric").isin(*candidates)).join(primary_metric_of(series.where(F.col("metric").isin(*candidates)), candidates), ["entity", "metric"]).select("entity", "ts", F.col("value").alias("revenue"))


def share_with_forecast(trend: DataFrame, forecast: DataFrame) -> DataFrame:
    """entity, ts, share, projected: each entity's part of all revenue per month, history and forecast alike."""
    both = trend.select("entity", "ts", "revenue", F.lit(False).alias("projected")).union(forecast.select("entity", "ts", "revenue", F.lit(True)))
    total = F.sum("revenue").over(Window.partitionBy("ts", "projected"))
    return both.select("entity", "ts", F.coalesce(F.try_divide("revenue", total), F.lit(0.0)).alias("share"), "projected")
