"""Queries of the compositions and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.operators import aggregates as A
from tallygrove.operators import confidence as G
from tallygrove.operators import contexts as X
from tallygrove.operators import kpis as K
from tallygrove.operators import windows as W
from tallygrove.plans import jobs
from tallygrove.plans.kpi_queries import _WIN, FORMULA_SQL, inputs
from tallygrove.plans.registry import on_facts, on_monthly, on_series, register, with_facts, with_monthly, with_series
from tallygrove.plans.scenario_queries import _CONF
from tallygrove.plans.window_queries import _SIGNALS_SQL

_S = "PARTITION BY entity, metric ORDER BY seq"

register("timeseries_factors", on_series(X.timeseries_factors))
register(
    "growth_context",
    on_series(X.growth_context),
    with_series(_SIGNALS_SQL.replace(", sig AS", ", gs AS") + _CONF + """
, lg AS (SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
, cf AS (SELECT entity, metric, CASE WHEN depth = 0 THEN 0 ELSE exp((ln(greatest(depth, 1e-9)) + ln(greatest(vol, 1e-9)) + ln(greatest(ano, 1e-9))) / 4) END * 0.6 + 0.4 AS p FROM sc)
SELECT entity, metric, round(short_growth, 6) AS short_growth, round(mid_growth, 6) AS mid_growth, round(long_growth, 6) AS long_growth, round(cagr, 6) AS cagr, round(short_growth - 2 * mid_growth + long_growth, 6) AS acceleration,
  seq >= 3 AS short_ok, seq >= 6 AS mid_ok, seq >= 12 AS long_ok, round(CASE WHEN seq >= 12 THEN p ELSE least(0.65, p * 0.8) END, 6)::DOUBLE AS confidence FROM lg JOIN cf USING (entity, metric)"""),
)
register(
    "growth_snapshot",
    on_series(lambda s: X.growth_snapshot(X.growth_context(s), "recurring_revenue")),
    with_series(f"""
, l AS (SELECT entity, (value - lag(value, 3) OVER w) / greatest(abs(lag(value, 3) OVER w), 1e-9) AS s, (value - lag(value, 6) OVER w) / greatest(abs(lag(value, 6) OVER w), 1e-9) AS m,
    (value - lag(value, 12) OVER w) / greatest(abs(lag(value, 12) OVER w), 1e-9) AS g FROM series WHERE metric = 'recurring_revenue' WINDOW w AS ({_S}) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq DESC) = 1)
SELECT entity, round(s, 6) AS short_growth, round(m, 6) AS mid_growth, round(g, 6) AS long_growth, coalesce(s, m, g) IS NOT NULL AS available FROM l"""),
)
register(
    "signal_enrichment",
    on_series(X.enrichment),
    with_series(f"""
, h AS (SELECT *, row_number() OVER ({_S}) - 1 >= count(*) OVER (PARTITION BY entity, metric) // 2 AS late FROM series)
, a AS (SELECT entity, metric, avg(CASE WHEN NOT late THEN value END) AS f, avg(CASE WHEN late THEN value END) AS l, stddev_pop(value) / greatest(abs(avg(value)), 1e-9) AS cv, coalesce(regr_slope(value, seq), 0) AS slope FROM h GROUP BY entity, metric)
SELECT entity, metric, CASE WHEN (l - f) / greatest(abs(f), 1e-9) > 0.05 THEN 'growing' WHEN (l - f) / greatest(abs(f), 1e-9) < -0.05 THEN 'declining' ELSE 'stable' END AS trend,
  CASE WHEN cv < 0.1 THEN 'low' WHEN cv < 0.3 THEN 'moderate' ELSE 'high' END AS volatility, CASE WHEN slope > 0.01 THEN 'up' WHEN slope < -0.01 THEN 'down' ELSE 'flat' END AS direction FROM a"""),
)


def _fetched(s: DataFrame) -> DataFrame:
    stored = W.latest(s).where("metric = 'arpu'").select("entity", "metric", (F.col("value") * 1.1).alias("forecast"), F.lit(0.9).alias("confidence"))
    return X.forecasts_or_fallback(s, stored).select("entity", "metric", "forecast", "source")


register(
    "forecast_fetch_or_fallback",
    on_series(_fetched),
    with_series("""
, f AS (SELECT entity, metric, count(*) AS n, arg_max(value, seq) AS last, coalesce(regr_slope(value, seq), 0) AS slope FROM series GROUP BY entity, metric)
SELECT entity, metric, round(CASE WHEN metric = 'arpu' THEN last * 1.1::DOUBLE ELSE last + slope END, 6) AS forecast, CASE WHEN metric = 'arpu' THEN 'stored' ELSE 'fallback' END AS source FROM f"""),
)
register(
    "forecast_summary",
    on_series(X.forecast_summary),
    with_series("""
, f AS (SELECT entity, metric, count(*) AS n, coalesce(regr_slope(value, seq), 0) AS slope, var_pop(value) AS vy, var_pop(seq) AS vx FROM series GROUP BY entity, metric)
, r AS (SELECT *, CASE WHEN vy < 1e-9 THEN 0 ELSE greatest(0, 1 - (vy - slope * slope * vx) / greatest(vy, 1e-9)) END AS r2 FROM f)
SELECT entity, metric, CASE WHEN slope > 0.01 THEN 'up' WHEN slope < -0.01 THEN 'down' ELSE 'flat' END AS direction, round(r2, 6) AS r_squared, n >= 4 AND r2 >= 0.2 AS valid FROM r"""),
)
register("residual_diagnostics", on_series(X.residual_diagnostics))
register("multivariate_scenarios", on_series(X.multivariate_scenarios))
register("peer_snapshot", on_series(X.peer_snapshot))


def _k() -> Column:
    """A number of each entity, so that inputs differ from entity to entity."""
    return F.substring("entity", 8, 10).cast("int")


def _risk(s: DataFrame) -> DataFrame:
    """Growths from the series; forecasts, scenarios and cohorts are there for some entities only."""
    g = W.latest(W.growth_signals(s.where("metric = 'recurring_revenue'")))
    some = lambda n, x: F.when(_k() % n != 0, x)
    mid = F.col("mid_growth")
    return X.risk_with_snapshots(g.select(
        "entity", (0.5 + _k() / 100).alias("confidence"), (_k() % 3 == 0).alias("forecast"), ((_k() - 12) / 20).alias("slope"), (_k() / 50).alias("deviation"), some(2, F.lit(0.1)).alias("acceleration"),
        some(4, F.lit(-0.1)).alias("revenue_delta"), some(5, F.lit(0.2)).alias("churn_delta"), some(7, F.col("short_growth")).alias("short_growth"), some(5, mid).alias("mid_growth"), some(7, F.col("long_growth")).alias("long_growth"),
        some(7, F.col("acceleration")).alias("trend_acceleration"), some(4, mid + 0.2).alias("best_growth"), some(4, mid - 0.3).alias("worst_growth"), some(5, F.lit(0.15)).alias("cohort_acceleration"),
    ))


register(
    "risk_with_snapshots",
    on_series(_risk),
    with_series(f"""
, l AS (SELECT entity, CAST(substr(entity, 8) AS INT) AS k, (value - lag(value, 3) OVER w) / greatest(abs(lag(value, 3) OVER w), 1e-9) AS s, (value - lag(value, 6) OVER w) / greatest(abs(lag(value, 6) OVER w), 1e-9) AS m,
    (value - lag(value, 12) OVER w) / greatest(abs(lag(value, 12) OVER w), 1e-9) AS g FROM series WHERE metric = 'recurring_revenue' WINDOW w AS ({_S}) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seq DESC) = 1)
, x AS (SELECT entity, k, 0.5 + k / 100.0 AS conf, k % 3 = 0 AS f, (k - 12) / 20.0 AS slope, k / 50.0 AS dev, CASE WHEN k % 2 <> 0 THEN 0.1 END AS acc, CASE WHEN k % 4 <> 0 THEN -0.1 END AS rd, CASE WHEN k % 5 <> 0 THEN 0.2 END AS cd,
    CASE WHEN k % 7 <> 0 THEN s END AS sg, CASE WHEN k % 5 <> 0 THEN m END AS mg, CASE WHEN k % 7 <> 0 THEN g END AS lg, CASE WHEN k % 7 <> 0 THEN s - 2 * m + g END AS ta, CASE WHEN k % 4 <> 0 THEN m + 0.2 END AS bg, CASE WHEN k % 4 <> 0 THEN m - 0.3 END AS wg, CASE WHEN k % 5 <> 0 THEN 0.15 END AS ca FROM l)
, y AS (SELECT *, abs(sg - lg) AS spread, abs(bg - wg) AS scen, greatest(0, -ta) AS slowing, coalesce(sg, mg, lg) IS NOT NULL AS hg, coalesce(bg, wg) IS NOT NULL AS hs FROM x)
, z AS (SELECT *, NOT f AND (ca IS NOT NULL OR hg OR hs) AS proxy, CASE WHEN f THEN CASE WHEN mg IS NULL THEN slope ELSE (slope + mg) / 2 END ELSE coalesce(nullif(mg, 0), nullif(wg, 0), 0) END AS fs,
    greatest(CASE WHEN f THEN dev ELSE 0 END, coalesce(spread, 0), coalesce(scen, 0)) AS fd, greatest(CASE WHEN f THEN coalesce(acc, 0) ELSE coalesce(ca, 0) END, coalesce(slowing, 0)) AS fa,
    (rd IS NOT NULL OR cd IS NOT NULL OR sg IS NOT NULL)::INT + f::INT + (NOT f AND ca IS NOT NULL)::INT + (CASE WHEN f THEN mg IS NOT NULL OR spread IS NOT NULL OR ta IS NOT NULL ELSE hg END)::INT + (CASE WHEN f THEN scen IS NOT NULL ELSE hs END)::INT AS dims FROM y)
, r AS (SELECT *, f OR proxy AS av, 0.25 * (1 - coalesce(sg, rd, 0)) / 2 + 0.25 * (1 + coalesce(cd, 0)) / 2 + CASE WHEN f OR proxy THEN 0.2 * least(1, greatest(0, -fs)) + 0.15 * least(1, greatest(0, fd)) + 0.15 * least(1, greatest(0, fa)) ELSE 0 END AS t FROM z)
, q AS (SELECT *, least(100, round_even(least(100, greatest(0, t * 100)), 0) / CASE WHEN av THEN 1 ELSE 0.5 END)::INT AS risk FROM r)
SELECT entity, CASE WHEN f THEN 'forecast' WHEN proxy AND hs THEN 'scenario_growth_cohort_proxy' WHEN proxy AND hg THEN 'growth_cohort_proxy' WHEN proxy THEN 'cohort_proxy' ELSE 'insufficient_data' END AS source, dims AS dimensions, risk AS risk_score,
  CASE WHEN risk <= 30 THEN 'low' WHEN risk <= 60 THEN 'moderate' WHEN risk <= 80 THEN 'high' ELSE 'critical' END AS level, round(CASE WHEN dims < 2 THEN greatest(0.05, conf - (0.3 + 0.1 * (2 - dims))) ELSE conf END, 6)::DOUBLE AS confidence FROM q"""),
)


def _quality(s: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("success", "insufficient_data", "failed", "skipped", "ok"))), (1 + (_k() + F.length("metric")) % 5).cast("int"))
    return X.data_quality(s.groupBy("entity", F.col("metric")).agg(F.avg("seq").alias("n")).select("entity", F.col("metric").alias("component"), status.alias("status"), (F.col("n") / 100).alias("confidence")))


_QUALITY = """
, n AS (SELECT entity, metric AS component, avg(seq) / 100 AS c, ['success', 'insufficient_data', 'failed', 'skipped', 'ok'][1 + (CAST(substr(entity, 8) AS INT) + length(metric)) % 5] AS st FROM series GROUP BY entity, metric)
, dq AS (SELECT entity, component, CASE WHEN st IN ('failed', 'skipped') THEN 'unavailable' WHEN st = 'insufficient_data' THEN 'partial' ELSE 'available' END AS state, round(CASE WHEN st IN ('failed', 'skipped') THEN 0 ELSE c END, 6)::DOUBLE AS confidence FROM n)"""
register("data_quality_components", on_series(_quality), with_series(_QUALITY + "\nSELECT * FROM dq"))
register(
    "data_quality_missing",
    on_series(lambda s: X.missing_components(_quality(s)).withColumn("missing", F.array_join("missing", ","))),
    with_series(_QUALITY + "\nSELECT entity, count(*) AS components, coalesce(string_agg(CASE WHEN state = 'unavailable' THEN component END, ',' ORDER BY component), '') AS missing FROM dq GROUP BY entity"),
)
register(
    "kpi_branch_rows",
    on_monthly(lambda m: X.kpi_rows_for(K.payload(K.compute(inputs(m), "saas"), "saas"), ("mrr", "growth_rate", "arr"), F.lit("1996-01-01").cast("date"))),
    with_monthly(_WIN + f"""
, k AS (SELECT entity, month, {FORMULA_SQL['saas']} FROM win WHERE month >= DATE '1996-01-01')
, a AS (SELECT entity, 2 * count(*) AS rows, (count(mrr) > 0)::INT + (count(growth_rate) > 0)::INT AS v FROM k GROUP BY entity)
SELECT entity, rows, v AS valid_metrics, CASE WHEN v = 3 THEN 'success' WHEN v > 0 THEN 'partial' ELSE 'failed' END AS status FROM a"""),
)
register(
    "category_formula_from_series",
    on_series(X.formula_from_series),
    with_series("""
, a AS (SELECT entity, sum(CASE WHEN metric = 'recurring_revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'active_customer_count' THEN v END) AS active
  FROM (SELECT *, last_value(value) OVER (PARTITION BY entity, metric ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM series) GROUP BY entity)
SELECT entity, round(revenue, 6) AS revenue, active, NULL::DOUBLE AS churn_rate, round(revenue / active, 6) AS arpu FROM a"""),
)


def _macro(s: DataFrame) -> DataFrame:
    rev = s.where("metric = 'recurring_revenue'")
    inflation = rev.select(F.last_day("ts").alias("period_end")).distinct().select("period_end", (F.month("period_end") / 1000).alias("value"))
    return X.macro_context(s, inflation, W.latest(rev).select("value"))


register("macro_context", on_series(_macro))
register(
    "insight_drivers",
    on_facts(lambda f: A.drivers(f.groupBy("entity").agg(F.array(F.when(F.count(F.lit(1)) > 500, "large").otherwise("small")).alias("issues")), A.dimension_summary(f), 2)),
    with_facts("""
, d AS (SELECT CASE WHEN grouping(region) = 0 THEN 'region' WHEN grouping(segment) = 0 THEN 'segment' WHEN grouping(channel) = 0 THEN 'channel' ELSE 'entity' END AS dimension,
    coalesce(region, segment, channel, entity) AS name, round(sum(value), 2) AS total FROM facts GROUP BY GROUPING SETS ((region), (segment), (channel), (entity)))
, p AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, name) AS place FROM d)
SELECT entity, CASE WHEN count(*) > 500 THEN 'large' ELSE 'small' END AS driver, 'root_cause' AS kind FROM facts GROUP BY entity
UNION ALL SELECT NULL, dimension || ':' || name, 'contributor' FROM p WHERE place <= 2"""),
)
register(
    "export_kpi_rows",
    on_monthly(lambda m: jobs.export_kpis(K.payload_map(K.payload(K.compute(inputs(m), "saas"), "saas"))).select("entity", "month", "metric", "unit", "is_valid", "error")),
    with_monthly(_WIN + f"""
, k AS (SELECT entity, month, {FORMULA_SQL['saas']} FROM win)
, h AS (SELECT * FROM k ORDER BY month DESC, entity LIMIT 100000)
, r AS (SELECT entity, month, unnest(['mrr', 'churn_rate', 'ltv', 'growth_rate']) AS metric, unnest(['value', 'ratio', 'value', 'ratio']) AS unit, unnest([mrr, churn_rate, ltv, growth_rate]) AS v FROM h)
SELECT entity, month, metric, unit, v IS NOT NULL AS is_valid, CASE WHEN v IS NULL THEN 'division_by_zero' END AS error FROM r"""),
)
register(
    "export_records",
    on_facts(lambda f: jobs.export_rows(f.select("entity", "ts", "id", "value"), "records", "1997-01-01", "1997-06-30")),
    with_facts("SELECT entity, ts, id, round(value, 6) AS value FROM facts WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1997-06-30' ORDER BY ts DESC, id DESC LIMIT 100000"),
)
