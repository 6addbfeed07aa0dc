"""Queries of the canonical scans, signal deltas, dashboards and category inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.operators import inference as N
from tallygrove.operators import series as S
from tallygrove.plans.registry import on_facts, on_monthly, on_series, register, rounded, with_facts, with_monthly, with_series
from tallygrove.sources import scans as C
from tallygrove.sources import star


def _year():
    """Start and end of the scanned period."""
    return (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1997-12-31"))


def _meta(f: DataFrame) -> DataFrame:
    """facts with a role and JSON metadata made from their own columns."""
    band = F.when(F.length("entity") % 2 == 0, '", "size_band": " Small ').when(F.col("id") % 3 == 0, '", "firm_size_band": "large').otherwise("")
    text = F.concat(F.lit('{"team": "'), F.col("segment"), F.lit('", "channel": "'), F.when(F.col("id") % 5 > 0, F.col("channel")).otherwise(""), F.lit('", "customer_segment": "'), F.col("segment"), band, F.lit('"}'))
    return f.withColumns({"role": F.lit("organization"), "metadata": text})


_M = """
, mf AS (SELECT *, nullif(CASE WHEN id % 5 > 0 THEN channel ELSE '' END, '') AS mchannel, CASE WHEN length(entity) % 2 = 0 THEN 'small' WHEN id % 3 = 0 THEN 'large' END AS band FROM facts)"""
_IN = "ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1997-12-31'"
register(
    "scan_dimension_rows",
    on_facts(lambda f: C.dimension_rows(_meta(f), "saas", *_year()).select("entity", "ts", "value", "team", "channel", "product_line")),
    with_facts(_M + f"\nSELECT entity, ts, round(value, 6) AS value, segment AS team, mchannel AS channel, NULL::VARCHAR AS product_line FROM mf WHERE {_IN}"),
)
register(
    "scan_cohort_rows",
    on_facts(lambda f: C.cohort_rows(_meta(f), "saas", *_year()).groupBy("acquisition_channel", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))),
    with_facts(_M + "\nSELECT mchannel AS acquisition_channel, segment, count(*) AS n, min(ts) AS first FROM mf WHERE ts >= TIMESTAMP '1997-01-01' - INTERVAL 365 DAY AND ts <= TIMESTAMP '1997-12-31' GROUP BY ALL"),
)
register(
    "scan_macro_rows",
    on_facts(lambda f: C.macro_rows(f.withColumn("category", F.when(F.col("id") % 4 == 0, "macro").otherwise("sales")), *_year()).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))),
    with_facts("SELECT count(*) AS n, min(ts) AS first FROM facts WHERE id % 4 = 0 AND ts >= TIMESTAMP '1997-01-01' - INTERVAL 730 DAY AND ts <= TIMESTAMP '1997-12-31'"),
)
register(
    "entity_size_bands",
    on_facts(lambda f: C.entity_band(_meta(f))),
    with_facts(_M + """
, r AS (SELECT entity, band, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, id DESC) AS r FROM mf)
SELECT entity, arg_min(band, r) FILTER (WHERE band IS NOT NULL) AS band FROM r WHERE r <= 500 GROUP BY entity"""),
)
register(
    "scan_peer_rows",
    on_facts(lambda f: C.peer_rows(_meta(f), "saas", "NATION_7", *_year()).groupBy("entity", "band").agg(F.count(F.lit(1)).alias("n"))),
    with_facts(_M + f"\nSELECT entity, band, count(*) AS n FROM mf WHERE {_IN} AND entity <> 'NATION_7' AND band = 'small' GROUP BY ALL"),
)
register(
    "cohort_metric_kinds",
    on_series(lambda s: s.select("metric").distinct().select("metric", C.metric_kind(F.col("metric"), churned=("arpu",)).alias("kind"))),
    with_series("SELECT DISTINCT metric, CASE metric WHEN 'arpu' THEN 'churn' WHEN 'active_customer_count' THEN 'active' ELSE 'other' END AS kind FROM series"),
)
register(
    "resolved_period_bounds",
    on_monthly(lambda m: C.period_bounds(m.select("entity", F.when(F.length("entity") % 2 == 0, F.col("month")).alias("period_start"), F.last_day("month").alias("period_end")))),
    with_monthly('SELECT entity, CASE WHEN length(entity) % 2 = 0 THEN max(month) ELSE last_day(max(month)) - 90 END::DATE AS start, last_day(max(month)) AS "end" FROM monthly GROUP BY entity'),
)
register(
    "kpi_signal_deltas",
    on_series(C.signal_deltas),
    with_series("""
, c AS (SELECT entity, metric, (value - lag(value) OVER w) / nullif(abs(lag(value) OVER w), 0) AS c FROM series WINDOW w AS (PARTITION BY entity, metric ORDER BY seq) QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
SELECT entity, round(coalesce(max(CASE WHEN metric = 'recurring_revenue' THEN c END), 0), 6) AS revenue_growth_delta, 0.0::DOUBLE AS churn_delta, 0.0::DOUBLE AS conversion_delta,
  2 + (max(CASE WHEN metric = 'recurring_revenue' THEN c END) IS NULL)::INT AS missing FROM c GROUP BY entity"""),
)
register(
    "primary_metric_pick",
    on_series(lambda s: C.primary_metric_of(s.where("metric <> 'recurring_revenue' or entity <> 'NATION_3'"), ("mrr", "recurring_revenue"))),
    with_series("SELECT entity, CASE WHEN entity = 'NATION_3' THEN 'active_customer_count' ELSE 'recurring_revenue' END AS metric FROM series GROUP BY entity"),
)
register(
    "revenue_trend",
    on_series(C.revenue_trend),
    with_series("SELECT entity, ts, round(value, 6) AS revenue FROM series WHERE metric = 'recurring_revenue'"),
)


def _dashboard(s: DataFrame) -> DataFrame:
    rev = s.where("metric = 'recurring_revenue'")
    ends = rev.groupBy("entity").agg(F.max("ts").alias("last"))
    ahead = S.linear_forecast(rev).join(ends, "entity").select("entity", F.expr("add_months(last, step)").alias("ts"), F.col("forecast").alias("revenue"))
    return C.share_with_forecast(C.revenue_trend(s), ahead)


register(
    "market_share_dashboard",
    on_series(_dashboard),
    with_series("""
, r AS (SELECT entity, ts, value FROM series WHERE metric = 'recurring_revenue')
, f AS (SELECT entity, (max(ts) + to_months(k))::DATE AS ts, arg_max(value, seq) + k * regr_slope(value, seq) AS value FROM series, (VALUES (1), (2), (3)) t(k) WHERE metric = 'recurring_revenue' GROUP BY entity, k)
, b AS (SELECT *, false AS projected FROM r UNION ALL SELECT *, true FROM f)
SELECT entity, ts, round(coalesce(value / nullif(sum(value) OVER (PARTITION BY ts, projected), 0), 0), 6) AS share, projected FROM b"""),
)


def _datasets(spark, sf_dir) -> DataFrame:
    """A dataset per table family: its names are those that the tables and derived metrics have."""
    n = star.table(spark, sf_dir, "orders").count()
    rows = [
        ("orders", ["gmv", "aov", "orders", "Revenue", "cac"], ["order_id", "date", "sku"], n),
        ("subscriptions", ["mrr", "arr", "churn_rate", "ltv", "recurring_revenue"], ["month", "plan", "region"], 60),
        ("wards", ["readmission_rate", "bed_occupancy_rate", "staff_hours"], ["date", "department"], 10),
        ("unknown", ["foo"], ["bar"], 1),
    ]
    return spark.createDataFrame(rows, "dataset string, metrics array<string>, columns array<string>, rows long")


register("category_signal_scores", lambda spark, d: rounded(N.category_scores(_datasets(spark, d))))
register("category_inference_weighted", lambda spark, d: rounded(N.infer(_datasets(spark, d))))
