"""Queries of ingestion, writing keys, scalar rules, pages, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import columns as C
from tallygrove.plans.registry import on_facts, on_monthly, on_series, on_table, register, with_facts, with_monthly, with_series
from tallygrove.sources import ingest as I
from tallygrove.sources import macro, star, web
from tallygrove.streaming import events as E


# Raw rows as an upload gives them: strings, some of them bad.
def raw_rows(spark, sf_dir) -> DataFrame:
    o = star.table(spark, sf_dir, "orders")
    bad = F.col("o_orderkey") % 11
    return o.select(
        F.col("o_orderkey").alias("_row"),
        F.when(bad == 1, "internal_system").otherwise("API").alias("source_type"),
        F.when(bad == 2, "  ").otherwise(F.concat(F.lit(" c"), F.col("o_custkey"), F.lit(" "))).alias("entity_name"),
        F.when(bad == 3, "SaaS").otherwise("Retail").alias("category"),
        F.when(bad == 4, "Sales").otherwise("").alias("role"),
        F.element_at(F.array(F.lit("Recurring_Revenue"), F.lit(" Churn_Rate"), F.lit("New Customers")), (1 + F.col("o_orderkey") % 3).cast("int")).alias("metric_name"),
        F.when(bad == 5, "{bad").when(bad == 6, F.concat(F.lit('{"value": '), F.col("o_orderkey"), F.lit("}"))).otherwise(F.col("o_orderkey").cast("string")).alias("metric_value"),
        F.when((bad == 3) & (F.col("o_orderkey") % 2 == 0), "").when(bad == 7, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("timestamp"),
        F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("R"), F.col("o_custkey") % 3)).alias("region"),
        F.when(bad == 8, "[1]").when(bad == 9, '{"a": 1}').otherwise("").alias("metadata_json"),
    )


_RAW = """
WITH raw AS (SELECT o_orderkey AS k, o_orderkey % 11 AS bad, o_custkey AS c, o_orderdate::DATE AS d, ['recurring_revenue', 'churn_rate', 'new customers'][1 + o_orderkey % 3] AS metric, CASE WHEN o_custkey % 3 > 0 THEN 'R' || (o_custkey % 3) END AS region FROM orders)
, t AS (SELECT *, CASE WHEN bad = 2 THEN 'required_missing' WHEN bad = 3 AND k % 2 = 0 THEN 'timestamp_required' WHEN bad = 7 THEN 'timestamp_invalid' WHEN bad = 5 THEN 'metric_json_invalid' WHEN bad = 8 THEN 'metadata_json_invalid' END AS error_code FROM raw)"""
register(
    "quarantine_rows",
    lambda spark, d: I.validate(raw_rows(spark, d))[1].select("_row", "error_code"),
    _RAW + "\nSELECT k AS _row, error_code FROM t WHERE error_code IS NOT NULL",
)
register(
    "canonical_rows",
    lambda spark, d: I.validate(raw_rows(spark, d))[0].select("_row", "source_type", "entity", "category", "role", "metric", "value", F.to_date("ts").alias("day"), "region", "metadata"),
    _RAW + """
SELECT k AS _row, CASE WHEN bad = 1 THEN 'csv' ELSE 'api' END AS source_type, 'c' || c AS entity, CASE WHEN bad = 3 THEN 'saas' ELSE 'retail' END AS category, CASE WHEN bad = 4 THEN 'sales' ELSE 'organization' END AS role,
  metric, k::DOUBLE AS value, d AS day, region, CASE WHEN bad = 9 THEN '{"a": 1}' END AS metadata FROM t WHERE error_code IS NULL""",
)
register(
    "canonical_payloads",
    lambda spark, d: I.validate(raw_rows(spark, d))[0].select("_row", F.schema_of_variant("payload").alias("kind"), F.to_json("payload").alias("payload")),
    _RAW + """
SELECT k AS _row, CASE WHEN bad = 6 THEN 'OBJECT<value: BIGINT>' ELSE 'BIGINT' END AS kind, CASE WHEN bad = 6 THEN '{"value":' || k || '}' ELSE k::VARCHAR END AS payload FROM t WHERE error_code IS NULL""",
)
register(
    "metric_value_kinds",
    lambda spark, d: raw_rows(spark, d).groupBy(I.value_kind(F.col("metric_value")).alias("kind")).count().withColumnRenamed("count", "n"),
    _RAW + "\nSELECT CASE bad WHEN 5 THEN 'string' WHEN 6 THEN 'json' ELSE 'int' END AS kind, count(*) AS n FROM t GROUP BY ALL",
)
register(
    "distinct_entity_scan",
    lambda spark, d: I.distinct_values(raw_rows(spark, d), "entity_name"),
    _RAW + "\nSELECT DISTINCT 'c' || c AS entity_name FROM t WHERE bad <> 2",
)
register(
    "dedupe_keep_first",
    on_facts(lambda f: I.keep_first(f.withColumn("_row", F.col("id")).withColumn("ts", F.trunc("ts", "month"))).select("entity", "ts", "id", "value")),
    with_facts("SELECT entity, date_trunc('month', ts)::DATE AS ts, id, round(value, 6) AS value FROM facts QUALIFY row_number() OVER (PARTITION BY entity, category, metric, date_trunc('month', ts) ORDER BY id) = 1"),
)
register(
    "insert_only_new",
    on_facts(lambda f: I.insert_new(f.where("id % 3 = 0"), f.withColumn("_row", F.col("id"))).select("entity", "ts", "id", "value")),
    with_facts("""
, inc AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY source_type, entity, category, metric, ts ORDER BY id) = 1)
SELECT entity, ts, id, round(value, 6) AS value FROM inc i WHERE NOT EXISTS (SELECT 1 FROM facts e WHERE e.id % 3 = 0 AND e.entity = i.entity AND e.ts = i.ts)"""),
)


def _upserted(m: DataFrame) -> DataFrame:
    k = m.select(F.lit("legacy").alias("tenant"), "entity", F.col("month").alias("period_start"), F.last_day("month").alias("period_end"), "revenue")
    new = k.where("month(period_start) <= 6").withColumn("revenue", F.col("revenue") * 2).withColumn("_row", F.lit(1).cast("long"))
    newer = k.where("month(period_start) <= 3").withColumn("revenue", F.col("revenue") * 3).withColumn("_row", F.lit(2).cast("long"))
    return I.upsert(k, new.union(newer)).select("entity", "period_start", "revenue")


register(
    "upsert_last_wins",
    on_monthly(_upserted),
    with_monthly("SELECT entity, month AS period_start, round(revenue * CASE WHEN month(month) <= 3 THEN 3 WHEN month(month) <= 6 THEN 2 ELSE 1 END, 6) AS revenue FROM monthly"),
)


def _runs(spark, sf_dir) -> DataFrame:
    return star.table(spark, sf_dir, "nation").select(F.lit("fred").alias("source"), F.col("n_regionkey").cast("string").alias("country"), F.col("n_nationkey").alias("version"))


register(
    "macro_run_versions",
    lambda spark, d: I.next_run_version(_runs(spark, d), "fred", "2"),
    "SELECT max(n_nationkey) + 1 AS version FROM nation WHERE n_regionkey = 2",
)
register(
    "single_current_run",
    lambda spark, d: I.only_current(_runs(spark, d)).select("country", "version", "is_current"),
    "SELECT n_regionkey::VARCHAR AS country, n_nationkey AS version, n_nationkey = max(n_nationkey) OVER (PARTITION BY n_regionkey) AS is_current FROM nation",
)


def _observations(spark, sf_dir) -> DataFrame:
    o = star.table(spark, sf_dir, "orders").groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("m")).agg(F.round(F.sum("o_totalprice") / 1e6, 4).alias("v"))
    kind = F.month("m") % 4
    start = F.when(kind == 0, F.date_add("m", 4)).otherwise(F.col("m"))
    end = F.when(kind == 0, F.date_add("m", 4)).when(kind == 1, F.date_add("m", 9)).otherwise(F.last_day("m"))
    return o.select(F.lit("de").alias("country"), F.lit("gdp").alias("metric"), start.alias("period_start"), end.alias("period_end"), F.when(kind == 2, "n/a").otherwise(F.col("v").cast("string")).alias("value"))


register(
    "macro_observation_transform",
    lambda spark, d: macro.transform_observations(_observations(spark, d), "M").select("period_start", "period_end", "frequency", F.round(F.col("number").cast("double"), 4).alias("number"), "error"),
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, round(sum(o_totalprice) / 1e6, 4) AS v FROM orders GROUP BY 1)
SELECT m AS period_start, CASE WHEN month(m) % 4 = 1 THEN m + 9 ELSE last_day(m) END AS period_end, CASE WHEN month(m) % 4 = 1 THEN 'U' ELSE 'M' END AS frequency,
  CASE WHEN month(m) % 4 <> 2 THEN v END AS number, CASE WHEN month(m) % 4 = 1 THEN 'frequency' WHEN month(m) % 4 = 2 THEN 'value' END AS error FROM m""",
)


def _wide(spark, sf_dir) -> DataFrame:
    m = star.monthly(star.facts(spark, sf_dir)).where("year(month) = 1996")
    return m.groupBy("entity").agg(
        *(F.max(F.when(F.month("month") == k, F.col("revenue"))).cast("string").alias(f"revenue_{n}_1996") for k, n in ((1, "Jan"), (2, "Feb"), (3, "Mar"), (12, "December"))),
        F.lit("nan").alias("cost_1996_Q2"),
    )


register(
    "wide_to_long",
    lambda spark, d: I.unpivot(_wide(spark, d)).select("entity", "metric_name", F.round(F.col("metric_value").cast("double"), 2).alias("value"), F.col("timestamp").alias("ts")),
    with_monthly("SELECT entity, 'revenue' AS metric_name, revenue AS value, month AS ts FROM monthly WHERE year(month) = 1996 AND month(month) IN (1, 2, 3, 12)"),
)
register(
    "flatten_json_props",
    on_table("events", lambda e: I.flatten_json(e.select("event_id", "props"), "props", ["k"]).select("event_id", F.col("props__k").cast("long").alias("props__k"))),
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS props__k FROM events",
)
register(
    "json_field_union",
    on_table("events", lambda e: I.json_keys(e, "props")),
    "SELECT DISTINCT unnest(json_keys(props)) AS name FROM events",
)

# Scalar rules over real columns.
_RATE = "p_retailprice / 10 - 60"
register(
    "percent_to_ratio_rules",
    on_table("part", lambda p: p.select("p_partkey", C.rate_open(F.expr(_RATE)).alias("open_rule"), C.rate_closed(F.expr(_RATE)).alias("closed_rule"), C.rate_strict(F.expr(_RATE)).alias("strict_rule"))),
    """WITH r AS (SELECT p_partkey, p_retailprice / 10 - 60 AS v FROM part)
SELECT p_partkey, round(CASE WHEN abs(v) > 1 AND abs(v) <= 100 THEN v / 100 ELSE v END, 6) AS open_rule, round(CASE WHEN abs(v) >= 1 AND abs(v) <= 500 THEN v / 100 ELSE v END, 6) AS closed_rule,
  round(CASE WHEN abs(v) > 100 THEN NULL WHEN abs(v) > 1 THEN v / 100 ELSE v END, 6) AS strict_rule FROM r""",
)
register(
    "real_growth_and_deflation",
    on_series(lambda s: s.select("entity", "metric", "seq", C.inflation_adjusted(F.when(F.col("seq") % 2 == 0, "growth_rate").otherwise("revenue"), F.col("value"), F.lit(0.02)).alias("adjusted"), C.macro_resilience(F.col("value"), F.col("value") * 0.9).alias("resilience"))),
    with_series("SELECT entity, metric, seq, round(CASE WHEN seq % 2 = 0 THEN (1 + value) / 1.02::DOUBLE - 1 ELSE value / 1.02::DOUBLE END, 6) AS adjusted, round(least(100, greatest(0, 100 - abs(value - value * 0.9::DOUBLE))), 6) AS resilience FROM series"),
)
register(
    "period_bounds_and_frequency",
    on_table("orders", lambda o: o.select(F.to_date("o_orderdate").alias("d")).distinct().select(
        "d", F.to_date(C.month_start(F.col("d"))).alias("month_start"), F.last_day("d").alias("month_end"), F.to_date(C.quarter_start(F.col("d"))).alias("quarter_start"), C.quarter_end(F.col("d")).alias("quarter_end"),
        C.frequency(F.trunc("d", "month"), F.last_day("d")).alias("frequency"), F.to_date(C.projection_quarter_end(F.col("d"), F.lit(1))).alias("next_quarter_end"))),
    """SELECT DISTINCT o_orderdate::DATE AS d, date_trunc('month', o_orderdate)::DATE AS month_start, last_day(o_orderdate::DATE) AS month_end, date_trunc('quarter', o_orderdate)::DATE AS quarter_start,
  (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end, 'M' AS frequency, last_day((o_orderdate::DATE + INTERVAL 3 MONTH)::DATE) AS next_quarter_end FROM orders""",
)
register(
    "monthly_windows",
    on_facts(lambda f: f.groupBy("entity").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("entity", F.explode(C.month_windows(F.col("a"), F.col("b"))).alias("start")).withColumn("end", F.add_months("start", 1))),
    with_facts("""
, b AS (SELECT entity, date_trunc('month', min(ts))::DATE AS a, max(ts)::DATE AS b FROM facts GROUP BY entity)
SELECT entity, m::DATE AS start, (m + INTERVAL 1 MONTH)::DATE AS "end" FROM b, generate_series(a, b, INTERVAL 1 MONTH) t(m)"""),
)
register(
    "kpi_period_start",
    on_facts(lambda f: f.groupBy("entity").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("entity", F.to_date(C.kpi_period_start(F.col("a"), F.col("b"))).alias("start"), F.to_date("b").alias("end"))),
    with_facts('SELECT entity, greatest(min(ts), max(ts) - INTERVAL 90 DAY)::DATE AS start, max(ts)::DATE AS "end" FROM facts GROUP BY entity'),
)
register(
    "traffic_suffixes",
    on_table("part", lambda p: p.select("p_partkey", C.traffic_number(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit("K+"), F.lit(".5M"), F.lit(""), F.lit("x")), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("traffic"))),
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN (p_size + 0.5) * 1000000 WHEN 2 THEN p_size END::DOUBLE AS traffic FROM part",
)
register(
    "normalized_headers",
    on_table("part", lambda p: p.select(C.normalized_header(F.col("p_type")).alias("header")).distinct()),
    "SELECT DISTINCT regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS header FROM part",
)
register(
    "correlation_p_values",
    on_table("part", lambda p: p.select("p_partkey", C.correlation_p_value(F.col("p_size") / 60, F.col("p_partkey") % 40).alias("p"))),
)
register(
    "log_saturation_and_vulnerability",
    on_table("part", lambda p: p.select("p_partkey", C.log_saturating(F.col("p_size").cast("double")).alias("saturation"), C.vulnerability(F.col("p_size") * 2.5).alias("vulnerability"))),
    "SELECT p_partkey, round(ln(p_size::DOUBLE) / ln(p_size + 1::DOUBLE), 6) AS saturation, round((100 - least(100, p_size * 2.5)) / 100, 6)::DOUBLE AS vulnerability FROM part",
)

# Pages and documents.
register(
    "page_titles",
    on_table("pages", web.page_titles),
    r"""SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain,
  trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages""",
)
register(
    "page_text",
    on_table("pages", lambda p: web.page_text(p).select("page_id", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.size("headlines").alias("headlines"))),
)
register("page_headlines", on_table("pages", lambda p: web.page_text(p).select("page_id", F.explode("headlines").alias("headline"))))
register("page_prices", on_table("pages", web.html_prices))
register("scraped_canonical_rows", on_table("pages", lambda p: web.scraped_rows(p, F.lit("2024-01-01").cast("timestamp_ntz"))))
register(
    "public_urls",
    on_table("pages", lambda p: p.select("page_id", C.is_public_url(F.col("url")).alias("public"), C.domain(F.col("url")).alias("domain"))),
    r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS d FROM pages)
SELECT page_id, regexp_matches(url, '^https?://') AND contains(d, '.') AND NOT contains(url, '@') AND NOT regexp_matches(d, '^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|^localhost$') AS public, d AS domain FROM h""",
)
register(
    "doc_price_percent_signals",
    on_table("documents", lambda d: web.document_signals(d.select("doc_id", F.concat_ws(" ", "text", F.lit("churn 4.5% growth 7%, 12.5 % at $1,200.50 and $"), (F.col("doc_id") % 90).cast("string")).alias("text")))),
    r"""WITH d AS (SELECT doc_id, concat_ws(' ', text, 'churn 4.5% growth 7%, 12.5 % at $1,200.50 and $', (doc_id % 90)::VARCHAR) AS t FROM documents)
, p AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)', 1), lambda x: replace(x, ',', '')::DOUBLE) AS p, list_transform(regexp_extract_all(t, '([0-9]+(?:\.[0-9]+)?)\s?%', 1), lambda x: x::DOUBLE) AS q FROM d)
SELECT doc_id, len(p) AS prices, round(list_sum(p) / len(p), 6) AS mean_price, round(CASE WHEN contains(lower(t), 'churn') THEN q[1] END, 6) AS churn_pct, round(CASE WHEN contains(lower(t), 'growth') THEN list_max(q) END, 6) AS growth_pct FROM p""",
)

# Events.
register(
    "event_daily_tumbling",
    on_table("events", lambda e: E.tumbling(e)),
    "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
)
register(
    "event_sliding_windows",
    on_table("events", lambda e: E.sliding(e)),
    """SELECT w AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (6), (12), (18)) t(h), LATERAL (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(h::INT) AS w) GROUP BY ALL""",
)
register(
    "event_session_windows",
    on_table("events", lambda e: E.sessions(e)),
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events)
, i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 6) AS total FROM i GROUP BY user_id, i.n""",
)
register(
    "event_running_counts",
    on_table("events", lambda e: E.running_counts(e).select("event_id", "place")),
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events",
)
