"""Queries of the aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.operators import aggregates as A
from tallygrove.operators import sets as T
from tallygrove.operators import windows as W
from tallygrove.plans.registry import on_facts, on_monthly, on_series, on_table, register, with_facts, with_monthly, with_series

register(
    "canonical_facts_summary",
    on_facts(lambda f: A.date_range(f, ["entity", "category"])),
    with_facts("SELECT entity, category, min(ts) AS earliest, max(ts) AS latest, count(*) AS records FROM facts GROUP BY ALL"),
)
register(
    "record_count_filtered",
    on_facts(lambda f: A.record_count(f, "NATION_7", "sales")),
    with_facts("SELECT count(*) AS records FROM facts WHERE entity = 'NATION_7' AND category = 'sales'"),
)
register(
    "period_revenue",
    on_facts(lambda f: f.where(A.in_period(F.col("ts"), F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1998-01-01").cast("timestamp_ntz")))
             .groupBy("entity").agg(F.round(A.period_sum(F.col("value")), 2).alias("revenue"), F.countDistinct("customer").alias("customers"))
             .withColumn("arpu", F.try_divide("revenue", "customers"))),
    with_facts("""
, p AS (SELECT entity, round(sum(value), 2) AS revenue, count(DISTINCT customer) AS customers FROM facts WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01' GROUP BY entity)
SELECT entity, revenue, customers, round(revenue / customers, 6) AS arpu FROM p"""),
)
register(
    "ordered_revenues",
    on_facts(lambda f: f.groupBy("entity", F.trunc("ts", "month").alias("month")).agg(F.to_json(A.ordered_values()).alias("xs"), F.count(F.lit(1)).alias("n")).select(
        "entity", "month", "n", F.sha2(F.concat_ws(",", F.transform(F.from_json("xs", "array<double>"), lambda x: F.round(x * 100).cast("long").cast("string"))).cast("binary"), 256).alias("digest"))),
    with_facts("""
SELECT entity, date_trunc('month', ts)::DATE AS month, count(*) AS n, sha256(string_agg(round(value * 100)::BIGINT::VARCHAR, ',' ORDER BY ts, id)) AS digest FROM facts GROUP BY ALL"""),
)
register(
    "distinct_on_latest_metric",
    on_facts(lambda f: A.distinct_on_latest(f.select("entity", "channel", "ts", "id", "value"), ["entity", "channel"], ("ts", "id"))),
    with_facts("SELECT entity, channel, ts, id, round(value, 6) AS value FROM facts QUALIFY row_number() OVER (PARTITION BY entity, channel ORDER BY ts DESC, id DESC) = 1"),
)
register(
    "distinct_entities_categories",
    on_facts(lambda f: f.select("entity", "category").distinct()),
    with_facts("SELECT DISTINCT entity, category FROM facts"),
)
register(
    "monthly_arpu_snapshot",
    on_monthly(lambda m: A.arpu_snapshot(m)),
    with_monthly("""
, s AS (SELECT entity, month, revenue, last_value(active) OVER (PARTITION BY entity ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS snapshot FROM monthly)
SELECT entity, month, revenue, snapshot, round(revenue / nullif(snapshot, 0), 6) AS arpu FROM s"""),
)
register("dataset_hash", on_facts(A.dataset_hash))

_DIM = """
, d AS (
  SELECT CASE WHEN grouping(region) = 0 THEN 'region' WHEN grouping(segment) = 0 THEN 'segment' WHEN grouping(channel) = 0 THEN 'channel' ELSE 'entity' END AS dimension,
    coalesce(region, segment, channel, entity) AS name, round(sum(value), 2) AS total, count(*) AS records
  FROM facts GROUP BY GROUPING SETS ((region), (segment), (channel), (entity))
), sh AS (SELECT *, greatest(total, 0) / sum(greatest(total, 0)) OVER (PARTITION BY dimension) AS share FROM d)
, dim AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY share DESC, total DESC, name) AS place FROM sh)"""
register(
    "dimension_contribution",
    on_facts(lambda f: A.dimension_summary(f)),
    with_facts(_DIM + "\nSELECT dimension, name, round(total, 6) AS total, records, round(share, 6) AS share, place FROM dim"),
)
register(
    "hhi_concentration",
    on_facts(lambda f: A.concentration(A.dimension_summary(f))),
    with_facts(_DIM + """
, h AS (SELECT dimension, sum(round(share, 6) * round(share, 6)) AS hhi, count(*) AS groups FROM dim GROUP BY dimension)
SELECT dimension, round(hhi, 6) AS hhi, groups, round(1 / hhi, 6) AS effective_groups FROM h"""),
)
register(
    "dimension_extremes",
    on_facts(lambda f: A.extremes(A.concentration(A.dimension_summary(f)))),
    with_facts(_DIM + """
, h AS (SELECT dimension, sum(round(share, 6) * round(share, 6)) AS hhi FROM dim GROUP BY dimension)
SELECT arg_max(dimension, hhi) AS most_concentrated, arg_min(dimension, hhi) AS least_concentrated FROM h"""),
)
register(
    "top_and_lagging_contributors",
    on_facts(lambda f: A.contributors(A.dimension_summary(f), 3)),
    with_facts(_DIM + """
, m AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY place DESC) AS l FROM dim)
SELECT dimension, name, round(total, 6) AS total, records, round(share, 6) AS share, place, CASE WHEN place <= 3 THEN 'top' ELSE 'laggard' END AS side FROM m WHERE place <= 3 OR l <= 3"""),
)
register(
    "segment_contribution",
    on_facts(lambda f: A.with_shares(f.groupBy("entity", F.col("segment").alias("name")).agg(F.round(F.sum("value"), 2).alias("total")), ["entity"])),
    with_facts("""
, g AS (SELECT entity, segment AS name, round(sum(value), 2) AS total FROM facts GROUP BY ALL)
, s AS (SELECT *, greatest(total, 0) / sum(greatest(total, 0)) OVER (PARTITION BY entity) AS share FROM g)
SELECT entity, name, round(total, 6) AS total, round(share, 6) AS share, row_number() OVER (PARTITION BY entity ORDER BY share DESC, total DESC, name) AS place FROM s"""),
)
register(
    "market_metric_stats",
    on_series(lambda s: A.metric_stats(s, ["metric"])),
    with_series("""
SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high,
  round(stddev_pop(value), 6) AS deviation FROM series GROUP BY metric"""),
)
register(
    "event_signal_stats",
    on_table("events", lambda e: A.metric_stats(e, ["event_type"])),
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high,
  round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type""",
)
register(
    "weighted_benchmark_stats",
    on_series(lambda s: A.weighted_stats(W.latest(s).withColumn("weight", (F.length("entity") % 5) / 4), ["metric"])),
    with_series("""
, l AS (SELECT *, (length(entity) % 5) / 4.0 AS w FROM series QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
, n AS (SELECT metric, value, w / sum(w) OVER (PARTITION BY metric) AS w FROM l WHERE w > 0)
, c AS (SELECT *, sum(w) OVER (PARTITION BY metric ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM n)
SELECT metric, count(*) AS n, round(sum(w * value), 6) AS mean, round(sqrt(greatest(sum(w * value * value) - sum(w * value) * sum(w * value), 0)), 6) AS deviation,
  round(min(CASE WHEN round(c, 12) >= 0.5 THEN value END), 6) AS median FROM c GROUP BY metric"""),
)
register(
    "median_absolute_deviation",
    on_series(lambda s: A.mad(s, ["entity", "metric"])),
    with_series("""
, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY entity, metric) AS med FROM series)
SELECT entity, metric, round(any_value(med), 6) AS median, round(quantile_cont(abs(value - med), 0.5), 6) AS mad FROM m GROUP BY entity, metric"""),
)
register(
    "bundle_confidence",
    on_facts(lambda f: f.groupBy("entity").agg(
        A.bundle_confidence(F.avg(F.col("value").isNotNull().cast("int")), F.countDistinct("channel"), F.avg(F.least(F.col("value") / 500000, F.lit(1.0)))).alias("confidence"))),
    with_facts("""
SELECT entity, round(0.4 * avg((value IS NOT NULL)::INT) + 0.3 * least(count(DISTINCT channel) / 10.0, 1) + 0.3 * avg(least(value / 500000, 1)), 6) AS confidence FROM facts GROUP BY entity"""),
)

_COHORT = """
, fi AS (SELECT customer, ts AS fts, channel AS fch, segment AS fse FROM facts QUALIFY row_number() OVER (PARTITION BY customer ORDER BY ts, id) = 1)
, tg AS (SELECT customer, 'signup_month' AS cohort_key, strftime(fts, '%Y-%m') AS cohort FROM fi UNION ALL SELECT customer, 'acquisition_channel', fch FROM fi UNION ALL SELECT customer, 'segment', fse FROM fi)
, mo AS (SELECT DISTINCT customer, date_trunc('month', ts)::DATE AS month FROM facts)
, ac AS (SELECT cohort_key, cohort, month, count(*) AS active FROM tg JOIN mo USING (customer) GROUP BY ALL)
, cv AS (
  SELECT *, row_number() OVER w - 1 AS seq, least(1, greatest(0, active / (first_value(active) OVER w)::DOUBLE)) AS retention,
    coalesce(greatest(0, (lag(active) OVER w - active) / (lag(active) OVER w)::DOUBLE), 0) AS churn FROM ac WINDOW w AS (PARTITION BY cohort_key, cohort ORDER BY month))
, st AS (SELECT *, greatest(lag(retention) OVER w - retention, 0) AS d, churn - 2 * lag(churn) OVER w + lag(churn, 2) OVER w AS b
  FROM cv WINDOW w AS (PARTITION BY cohort_key, cohort ORDER BY seq))"""
register(
    "cohort_retention",
    on_facts(lambda f: A.cohort_activity(f, A.cohort_keys()).select("cohort_key", "cohort", "month", "seq", "active", "retention", "churn")),
    with_facts(_COHORT + "\nSELECT cohort_key, cohort, month, seq, active, round(retention, 6) AS retention, round(churn, 6) AS churn FROM cv"),
)
register(
    "retention_decay",
    on_facts(lambda f: A.cohort_summary(A.cohort_activity(f, A.cohort_keys()))),
    with_facts(_COHORT + """
SELECT cohort_key, cohort, count(*) AS points, round(avg(d), 6) AS decay, round(sum(retention), 6) AS lifetime, round(avg(b), 6) + 0.0 AS churn_acceleration, count(*) < 3 AS sparse FROM st GROUP BY cohort_key, cohort"""),
)
register(
    "cohort_overview",
    on_facts(lambda f: A.cohort_overview(A.cohort_summary(A.cohort_activity(f, A.cohort_keys())))),
    with_facts(_COHORT + """
, su AS (SELECT cohort_key, cohort, avg(d) AS decay, sum(retention) AS lifetime, avg(b) AS ca, count(*) < 3 AS sparse FROM st GROUP BY cohort_key, cohort)
, ra AS (SELECT *, row_number() OVER (PARTITION BY cohort_key ORDER BY round(coalesce(decay, 0) + greatest(coalesce(ca, 0), 0), 9) DESC, cohort) AS bad FROM su)
, ov AS (SELECT cohort_key, count(*) AS cohorts, avg(decay) AS decay, avg(lifetime) AS lifetime, avg(ca) AS ca, count(CASE WHEN sparse THEN 1 END) AS sparse, max(CASE WHEN bad = 1 THEN cohort END) AS worst_cohort FROM ra GROUP BY cohort_key)
SELECT cohort_key, cohorts, round(decay, 6) AS decay, round(lifetime, 6) AS lifetime, round(ca, 6) + 0.0 AS churn_acceleration, sparse, worst_cohort,
  CASE WHEN decay >= 0.1 OR ca >= 0.05 THEN 'high' WHEN decay >= 0.05 OR ca >= 0.02 THEN 'moderate' ELSE 'low' END AS risk_hint FROM ov"""),
)

# Top-k: the limit is the feature.
register(
    "newest_records",
    on_facts(lambda f: T.newest(f.select("entity", "ts", "id", "value"), 1000)),
    with_facts("SELECT entity, ts, id, round(value, 6) AS value FROM facts ORDER BY ts DESC, id DESC LIMIT 1000"),
)
register(
    "newest_per_entity",
    on_facts(lambda f: T.first_per_key(f.select("entity", "ts", "id", "value"), ["entity"], [F.desc("ts"), F.desc("id")], 10)),
    with_facts("SELECT entity, ts, id, round(value, 6) AS value FROM facts QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, id DESC) <= 10"),
)
register(
    "latest_entity",
    on_facts(lambda f: T.newest(f.select("entity", "ts", "id"), 1)),
    with_facts("SELECT entity, ts, id FROM facts ORDER BY ts DESC, id DESC LIMIT 1"),
)
_DEPTH = """
, dp AS (SELECT entity, metric, count(*) AS n FROM series GROUP BY ALL HAVING count(*) >= 4)"""
register(
    "metric_selection_by_depth",
    on_series(lambda s: T.select_metrics(s, 4, 3)),
    with_series(_DEPTH + "\nSELECT entity, metric, n FROM dp QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, metric) <= 3"),
)
register(
    "metric_selection_preferred",
    on_series(lambda s: T.select_metrics(s, 4, 3, ("recurring_revenue", "arpu"))),
    with_series(_DEPTH + """
SELECT entity, metric, n FROM dp QUALIFY row_number() OVER (PARTITION BY entity ORDER BY CASE metric WHEN 'recurring_revenue' THEN 0 WHEN 'arpu' THEN 1 ELSE 2 END, n DESC, metric) <= 3"""),
)
register(
    "strongest_weakest_metric",
    on_series(lambda s: T.strongest_weakest(W.minmax(W.latest(s), ["metric"], "value", "score"))),
    with_series("""
, l AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
, sc AS (SELECT entity, metric, CASE WHEN max(value) OVER w - min(value) OVER w <= 1e-9 THEN 50 ELSE least(100, greatest(0, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 100)) END AS score FROM l WINDOW w AS (PARTITION BY metric))
, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(score, 9) DESC, metric) AS hi, row_number() OVER (PARTITION BY entity ORDER BY round(score, 9), metric) AS lo FROM sc)
SELECT entity, max(CASE WHEN hi = 1 THEN metric END) AS strongest, max(CASE WHEN lo = 1 THEN metric END) AS weakest FROM o GROUP BY entity"""),
)
register(
    "kpis_within_period",
    on_monthly(lambda m: T.within_period(m.select("entity", "month", F.last_day("month").alias("month_end"), "revenue"), "month", "month_end", "1996-01-01", "1996-12-31")),
    with_monthly("SELECT entity, month, last_day(month) AS month_end, round(revenue, 6) AS revenue FROM monthly WHERE month >= DATE '1996-01-01' AND last_day(month) <= DATE '1996-12-31'"),
)

# Sets.
register(
    "distinct_names_case_insensitive",
    on_table("part", lambda p: T.distinct_ignoring_case(p.select("p_type", "p_partkey"), "p_type", ["p_partkey"])),
    "SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_type)) ORDER BY p_partkey) = 1",
)
register(
    "distinct_urls_in_order",
    on_table("pages", lambda p: T.first_per_key(p.select("url", "page_id"), ["url"], [F.asc("page_id")], 1)),
    "SELECT url, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1",
)
register(
    "urls_not_blacklisted",
    lambda spark, d: T.without_domains(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), "url", spark.createDataFrame([("example.org",), ("site1.example.com",)], "domain string")),
    r"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, url FROM h WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('example.org'), ('site1.example.com')) t(d) WHERE host = d OR ends_with(host, '.' || d))""",
)
register(
    "missing_required_metrics",
    on_series(lambda s: T.missing_required(s, ("recurring_revenue", "active_customer_count", "churned_customer_count"), ("arpu", "ltv"))),
    with_series("""
, have AS (SELECT DISTINCT entity, metric FROM series)
, e AS (SELECT DISTINCT entity FROM series)
SELECT entity,
  coalesce((SELECT string_agg(m, ',' ORDER BY m) FROM (VALUES ('recurring_revenue'), ('active_customer_count'), ('churned_customer_count')) t(m) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.entity = e.entity AND h.metric = m)), '') AS missing_required,
  coalesce((SELECT string_agg(m, ',' ORDER BY m) FROM (VALUES ('arpu'), ('ltv')) t(m) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.entity = e.entity AND h.metric = m)), '') AS missing_optional
FROM e"""),
)
register(
    "entities_overridden",
    lambda spark, d: T.override(
        spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")),
        spark.createDataFrame([("NATION_7", "override"), ("ATLANTIS", "new")], "key string, value string")),
    """SELECT coalesce(o.key, n.n_name) AS key, coalesce(o.value, n.n_regionkey::VARCHAR) AS value
FROM nation n FULL JOIN (VALUES ('NATION_7', 'override'), ('ATLANTIS', 'new')) o(key, value) ON o.key = n.n_name""",
)
register(
    "shared_metric_pair",
    on_series(lambda s: T.first_shared(s.where("entity = 'NATION_7'"), s.where("entity = 'NATION_3'"), ("mrr", "arpu", "recurring_revenue"))),
    with_series("""
SELECT m AS metric FROM (VALUES (0, 'mrr'), (1, 'arpu'), (2, 'recurring_revenue')) t(i, m)
WHERE EXISTS (SELECT 1 FROM series WHERE entity = 'NATION_7' AND metric = m) AND EXISTS (SELECT 1 FROM series WHERE entity = 'NATION_3' AND metric = m) ORDER BY i LIMIT 1"""),
)
