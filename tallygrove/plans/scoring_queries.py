"""Queries of joins, peer scores, risk, root causes and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import columns as C
from tallygrove.operators import confidence as G
from tallygrove.operators import joins as J
from tallygrove.operators import scoring as R
from tallygrove.operators import series as S
from tallygrove.operators import windows as W
from tallygrove.plans.registry import on_facts, on_monthly, on_series, register, rounded, with_facts, with_monthly, with_series
from tallygrove.plans.series_queries import _TAIL
from tallygrove.sources import macro, star
from tallygrove.sources.packs import alias_table

_LATEST = """
, latest AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)"""


# Macro intervals that the orders give: one a quarter.
def _macro(spark, sf_dir, scale: float) -> DataFrame:
    """period_start, period_end, value: a yearly-drifting rate per quarter of the orders' span."""
    q = star.table(spark, sf_dir, "orders").select(F.to_date(C.quarter_start(F.col("o_orderdate"))).alias("period_start")).distinct()
    v = (F.month("period_start") + F.year("period_start") - 1990) * scale
    return q.select("period_start", C.quarter_end(F.col("period_start")).alias("period_end"), v.alias("value")).where("month(period_start) <> 7")


def macro_asof_real_growth(spark, sf_dir):
    months = star.monthly(star.facts(spark, sf_dir))
    s = star.series(months).where("metric = 'recurring_revenue'")
    kpis = W.growth(s).select("entity", F.last_day("ts").alias("period_end"), "growth")
    return rounded(macro.real_growth(kpis, _macro(spark, sf_dir, 0.001), _macro(spark, sf_dir, 0.002), _macro(spark, sf_dir, 0.003)).select(
        "entity", "period_end", "growth", "inflation", "gdp", "policy_rate", "real_growth", "vs_gdp", "efficiency"))


register(
    "macro_asof_real_growth",
    macro_asof_real_growth,
    with_series("""
, mq AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE AS s FROM orders WHERE month(date_trunc('quarter', o_orderdate)) <> 7)
, mm AS (SELECT s, (s + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS e, (month(s) + year(s) - 1990) AS v FROM mq)
, g AS (SELECT entity, last_day(ts) AS period_end, (value - lag(value) OVER w) / greatest(abs(lag(value) OVER w), 1e-9) AS growth FROM series WHERE metric = 'recurring_revenue' WINDOW w AS (PARTITION BY entity ORDER BY seq))
, d AS (SELECT DISTINCT period_end FROM g)
, a AS (SELECT d.period_end, CASE WHEN mm.e >= d.period_end THEN mm.v END AS v FROM d ASOF LEFT JOIN mm ON d.period_end >= mm.s)
, j AS (SELECT g.*, v * 0.001::DOUBLE AS inflation, v * 0.002::DOUBLE AS gdp, v * 0.003::DOUBLE AS policy_rate FROM g JOIN a USING (period_end))
, r AS (SELECT *, (1 + growth) / (1 + inflation) - 1 AS rg FROM j)
SELECT entity, period_end, round(growth, 6) AS growth, round(inflation, 6) AS inflation, round(gdp, 6) AS gdp, round(policy_rate, 6) AS policy_rate, round(rg, 6) AS real_growth,
  round(rg - gdp, 6) AS vs_gdp, round(rg / (1 + greatest(policy_rate, -0.95)), 6) AS efficiency FROM r"""),
)


def asof_snapshot(spark, sf_dir):
    """Each order beside the newest order that its customer placed at least a day before."""
    o = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    left = o.select("o_orderkey", "o_custkey", (F.col("o_orderdate") - F.expr("interval 1 day")).alias("at"))
    right = o.select("o_custkey", F.col("o_orderdate").alias("start"), "o_totalprice")
    return rounded(J.asof(left, right.groupBy("o_custkey", "start").agg(F.max("o_totalprice").alias("o_totalprice")), "at", "start", ("o_custkey",), ("o_totalprice",)))


register(
    "asof_latest_snapshot",
    asof_snapshot,
    """WITH r AS (SELECT o_custkey, o_orderdate AS start, max(o_totalprice) AS p FROM orders GROUP BY ALL)
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate - INTERVAL 1 DAY AS at, round(r.p, 6) AS o_totalprice
FROM orders o ASOF LEFT JOIN r ON o.o_custkey = r.o_custkey AND o.o_orderdate - INTERVAL 1 DAY >= r.start""",
)
register(
    "previous_period_join",
    on_monthly(lambda m: J.with_previous(m.select("entity", "month", "revenue", "active"), "entity", "month", ("revenue", "active"))),
    with_monthly("""
SELECT c.entity, c.month, round(c.revenue, 6) AS revenue, c.active, round(p.revenue, 6) AS previous_revenue, p.active AS previous_active
FROM monthly c LEFT JOIN monthly p ON p.entity = c.entity AND (p.month + INTERVAL 1 MONTH)::DATE = c.month"""),
)
register(
    "latest_row_per_entity",
    on_monthly(lambda m: J.latest_row(m.select("entity", "month", "revenue", "active"), ["entity"], "month")),
    with_monthly("SELECT entity, month, round(revenue, 6) AS revenue, active FROM monthly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY month DESC) = 1"),
)
register(
    "peer_size_band",
    on_facts(lambda f: J.peers_by_size(f.groupBy("entity").agg(F.round(F.sum("value"), 2).alias("size")), "entity", "size", 0.97, 1.03, 3, 5)),
    with_facts("""
, z AS (SELECT entity, round(sum(value), 2) AS size FROM facts GROUP BY entity)
, near AS (SELECT a.entity AS client, b.entity AS peer FROM z a JOIN z b ON a.entity <> b.entity AND b.size BETWEEN a.size * 0.97::DOUBLE AND a.size * 1.03::DOUBLE)
, cnt AS (SELECT client FROM near GROUP BY client HAVING count(*) >= 3)
, fb AS (SELECT entity AS peer FROM z ORDER BY entity LIMIT 6)
, al AS (SELECT * FROM near WHERE client IN (SELECT client FROM cnt) UNION ALL SELECT entity, peer FROM z, fb WHERE entity NOT IN (SELECT client FROM cnt) AND entity <> peer)
SELECT client, peer, row_number() OVER (PARTITION BY client ORDER BY peer) AS place FROM al QUALIFY place <= 5"""),
)
register(
    "peers_excluding_client",
    on_facts(lambda f: f.where("category = 'sales' and entity <> 'NATION_7'").select("entity").distinct()),
    with_facts("SELECT DISTINCT entity FROM facts WHERE category = 'sales' AND entity <> 'NATION_7'"),
)
register(
    "peers_in_size_band",
    on_facts(lambda f: J.peers_in_band(f.groupBy("entity").agg(F.round(F.sum("value"), 2).alias("size")).withColumn("band", J.size_band(F.col("size") / 100)).select("entity", "band"), "medium")),
    with_facts("""
, b AS (SELECT entity, CASE WHEN round(sum(value), 2) / 100 < 1e6 THEN 'small' WHEN round(sum(value), 2) / 100 < 1e7 THEN 'medium' ELSE 'large' END AS band FROM facts GROUP BY entity)
SELECT entity, band FROM b WHERE band = 'medium' OR NOT EXISTS (SELECT 1 FROM b WHERE band = 'medium')"""),
)


def _observed(s: DataFrame) -> DataFrame:
    last = W.latest(s).select("entity", "metric", "value")
    tagged = last.withColumns({"unit": F.when((F.col("metric") == "arpu") & (F.length("entity") > 8), "eur").otherwise("usd"), "scale": F.when(F.length("entity") % 2 == 0, "ratio").otherwise("percentage")})
    return J.observations(tagged.where("entity = 'NATION_7'"), tagged.where("entity <> 'NATION_7'"))


register(
    "metric_observations",
    on_series(_observed),
    with_series(_LATEST + """
, t AS (SELECT entity, metric, value, CASE WHEN metric = 'arpu' AND length(entity) > 8 THEN 'eur' ELSE 'usd' END AS unit, CASE WHEN length(entity) % 2 = 0 THEN 'ratio' ELSE 'percentage' END AS scale FROM latest)
, j AS (SELECT p.entity, p.metric, c.value AS cv, p.unit <> c.unit AS bad, CASE WHEN p.scale = c.scale THEN p.value WHEN p.scale = 'percentage' THEN p.value / 100 ELSE p.value * 100 END AS v
  FROM t p JOIN t c ON c.entity = 'NATION_7' AND c.metric = p.metric WHERE p.entity <> 'NATION_7')
SELECT entity, metric, round(cv, 6) AS client_value, round(CASE WHEN NOT bad THEN v END, 6) AS peer_value, CASE WHEN bad THEN 'unit_mismatch' END AS reason, CASE WHEN bad THEN 0.35 ELSE 1.0 END::DOUBLE AS confidence FROM j"""),
)
register(
    "metric_directions",
    on_series(lambda s: s.select("metric").distinct().withColumn("direction", J.direction(F.col("metric")))),
    with_series("SELECT DISTINCT metric, 'higher_is_better' AS direction FROM series"),
)
register(
    "alias_dimension_join",
    lambda spark, d: J.canonical_names(star.series(star.monthly(star.facts(spark, d))).select("entity", "metric").distinct(), alias_table(spark), "saas").select("entity", "metric", "canonical"),
    with_series("SELECT DISTINCT entity, metric, CASE metric WHEN 'recurring_revenue' THEN metric WHEN 'active_customer_count' THEN metric END AS canonical FROM series"),
)


def _scope(spark, sf_dir):
    rows = star.facts(spark, sf_dir).select("entity").distinct()
    known = spark.createDataFrame([("legacy", "nation_7", "id-1"), ("other", "nation_3", "id-2")], "tenant string, entity_key string, entity_id string")
    return J.resolve_scope(rows, known)[0].select("entity", "entity_key", F.when(F.col("entity_id") == "id-1", "known").otherwise(F.col("entity_id")).alias("entity_id"))


register(
    "entity_scope_resolution",
    _scope,
    with_facts("SELECT DISTINCT entity, lower(trim(entity)) AS entity_key, CASE WHEN entity = 'NATION_7' THEN 'known' ELSE sha256('legacy:' || lower(trim(entity))) END AS entity_id FROM facts"),
)

# Scores.
_SCORES = _LATEST + """
, sw AS (SELECT entity, metric, value, count(value) OVER w - 1 AS n, sum(value) OVER w - value AS s, sum(value * value) OVER w - value * value AS q, quantile_cont(value, 0.5) OVER w AS med,
    rank() OVER (PARTITION BY metric ORDER BY value) - 1 AS below FROM latest WINDOW w AS (PARTITION BY metric))
, sm AS (SELECT *, s / n AS mean, CASE WHEN n < 2 THEN 0 ELSE sqrt(greatest(q / n - (s / n) * (s / n), 0)) END AS sd FROM sw WHERE n > 0)
, scores AS (SELECT *, least(3, greatest(-3, (value - mean) / greatest(sd, 1e-9))) AS z, 100 / (1 + exp(-least(3, greatest(-3, (value - mean) / greatest(sd, 1e-9))))) AS score FROM sm)"""
_TIER = "CASE WHEN {0} >= 80 THEN 'top' WHEN {0} >= 60 THEN 'above_average' WHEN {0} >= 40 THEN 'average' WHEN {0} >= 20 THEN 'below_average' ELSE 'bottom' END"


def _scores(s: DataFrame) -> DataFrame:
    return R.relative_scores(W.latest(s).select("entity", "metric", "value"))


register(
    "percentile_rank_score",
    on_series(lambda s: _scores(s).withColumns({"z": F.round("z", 4), "score": F.round("score", 4), "benchmark_std": F.round("benchmark_std", 4)})),
    with_series(_SCORES + f"""
SELECT entity, metric, round(value, 6) AS value, round(mean, 6) AS benchmark_mean, round(sd, 4) AS benchmark_std, round(z, 4) AS z, round(score, 4) AS score, round(below / n::DOUBLE * 100, 6) AS percentile,
  round((value - med) / greatest(abs(med), 1e-9) * 100, 6) AS deviation_pct, {_TIER.format('score')} AS tier FROM scores"""),
)
register(
    "confidence_weighted_score",
    on_series(lambda s: R.confidence_weighted(_scores(s), F.length("entity") / 12).select("entity", "metric", F.round("confidence_score", 4).alias("confidence_score"))),
    with_series(_SCORES + "\nSELECT entity, metric, round(50 + (score - 50) * least(1, length(entity) / 12.0), 4)::DOUBLE AS confidence_score FROM scores"),
)
register(
    "macro_score_summary",
    on_series(lambda s: R.macro_summary(_scores(s), 0.03).select("entity", "metric", *(F.round(c, 4).alias(c) for c in ("nominal_score", "real_score", "macro_resilience")))),
    with_series(_SCORES + """
, m AS (SELECT *, 100 / (1 + exp(-least(3, greatest(-3, (value / 1.03::DOUBLE - mean / 1.03::DOUBLE) / greatest(sd, 1e-9))))) AS rs FROM scores)
SELECT entity, metric, round(score, 4) AS nominal_score, round(rs, 4) AS real_score, round(least(100, greatest(0, 100 - abs(rs - score))), 4) AS macro_resilience FROM m"""),
)
_COMPOSITE = _SCORES + """
, lv AS (SELECT entity, avg(score) AS ls FROM scores GROUP BY entity)
, mv AS (SELECT entity, seq, value, (value - lag(value) OVER w) / greatest(abs(lag(value) OVER w), 1e-9) AS g FROM series WHERE metric = 'recurring_revenue' WINDOW w AS (PARTITION BY entity ORDER BY seq))
, pe AS (SELECT entity, CASE WHEN count(value) < 2 THEN 50 ELSE 100 / (1 + stddev_pop(value) / greatest(abs(avg(value)), 1e-9)) END AS ss, coalesce(arg_max(g, seq), 0) AS g FROM mv GROUP BY entity)
, cp AS (SELECT entity, least(100, greatest(0, 50 + g * 100)) AS gs, ls, ss FROM lv JOIN pe USING (entity))
, co AS (SELECT *, 0.4 * gs + 0.3 * ls + 0.2 * ss + 5 AS total FROM cp)"""
register(
    "composite_score",
    on_series(lambda s: R.composite(_scores(s), s).select("entity", *(F.round(c, 4).alias(c) for c in ("growth_score", "level_score", "stability_score", "overall_score")), "position")),
    with_series(_COMPOSITE + """
SELECT entity, round(gs, 4) AS growth_score, round(ls, 4) AS level_score, round(ss, 4) AS stability_score, round(total, 4) AS overall_score,
  CASE WHEN total >= 65 AND gs >= 55 THEN 'Leader' WHEN total <= 35 OR gs <= 40 AND total <= 50 THEN 'Declining' WHEN gs >= 60 AND ss >= 40 THEN 'Challenger' ELSE 'Stable' END AS position FROM co"""),
)
register(
    "score_bands",
    on_series(lambda s: R.composite(_scores(s), s).select("entity", C.score_band(F.col("overall_score")).alias("band"), F.round(C.band_confidence(F.col("overall_score")), 4).alias("confidence"), C.score_position(F.col("overall_score")).alias("position"))),
    with_series(_COMPOSITE + """
, b AS (SELECT entity, total, CASE WHEN total >= 85 THEN 85 WHEN total >= 70 THEN 70 WHEN total >= 50 THEN 50 WHEN total >= 30 THEN 30 ELSE 0 END AS lo, CASE WHEN total >= 85 THEN 100 WHEN total >= 70 THEN 85 WHEN total >= 50 THEN 70 WHEN total >= 30 THEN 50 ELSE 30 END AS hi FROM co)
SELECT entity, CASE lo WHEN 85 THEN 'Market Leader' WHEN 70 THEN 'Strong Performer' WHEN 50 THEN 'Competitive' WHEN 30 THEN 'Underperforming' ELSE 'Critical Risk' END AS band,
  round(least(total - lo, hi - total) / ((hi - lo) / 2.0), 4)::DOUBLE AS confidence,
  CASE WHEN total >= 90 THEN 'Top 10%' WHEN total >= 75 THEN 'Top 25%' WHEN total >= 50 THEN 'Top 50%' WHEN total >= 25 THEN 'Bottom 50%' ELSE 'Bottom 25%' END AS position FROM b"""),
)
register(
    "category_weighted_score",
    on_series(lambda s: R.category_mean(_scores(s), {"recurring_revenue": "level", "arpu": "level", "order_count": "activity", "active_customer_count": "activity"}, {"level": 0.6, "activity": 0.4})
              .select("entity", F.round("overall_score", 4).alias("overall_score"))),
    with_series(_SCORES + """
, c AS (SELECT entity, CASE WHEN metric IN ('recurring_revenue', 'arpu') THEN 'level' ELSE 'activity' END AS cat, avg(score) AS s FROM scores GROUP BY ALL)
SELECT entity, round(sum(CASE cat WHEN 'level' THEN 0.6 ELSE 0.4 END * s) / sum(CASE cat WHEN 'level' THEN 0.6 ELSE 0.4 END), 4)::DOUBLE AS overall_score FROM c GROUP BY entity"""),
)

_GROW = """
, gr AS (SELECT entity, metric, seq, value, (value - lag(value) OVER w) / greatest(abs(lag(value) OVER w), 1e-9) AS g FROM series WINDOW w AS (PARTITION BY entity, metric ORDER BY seq))"""


def _frame(s: DataFrame) -> DataFrame:
    g = W.growth(s.where("metric = 'recurring_revenue'"))
    return g.groupBy("entity").agg(F.max_by("growth", "seq").alias("growth"), F.max_by("value", "seq").alias("revenue"), (F.stddev_pop("value") / F.avg("value")).alias("risk"))


register(
    "benchmark_metrics",
    on_series(lambda s: R.benchmark_metrics(_frame(s))),
    with_series(_GROW + """
, f AS (SELECT entity, arg_max(g, seq) AS growth, arg_max(value, seq) AS revenue, stddev_pop(value) / avg(value) AS risk FROM gr WHERE metric = 'recurring_revenue' GROUP BY entity)
, o AS (SELECT *, (sum(growth) OVER () - growth) / nullif(count(*) OVER () - 1, 0) AS og, (sum(risk) OVER () - risk) / nullif(count(*) OVER () - 1, 0) AS orr, sum(greatest(revenue, 0)) OVER () AS t FROM f)
, b AS (SELECT entity, (1 + growth) / (1 + og) AS rgi, revenue / t AS msp, least(100, greatest(0, 50 + 50 * (orr - risk) / greatest(abs(orr), 1e-9))) AS rd FROM o)
SELECT entity, round(rgi, 6) AS relative_growth_index, round(msp, 6) AS market_share_proxy, round(rd, 6) AS risk_divergence,
  CASE WHEN rgi >= 1.05 AND msp >= 0.05 AND rd >= 50 THEN 'Leader' WHEN rgi >= 1.02 THEN 'Challenger' WHEN rgi < 0.95 OR rd < 25 THEN 'Declining' ELSE 'Stable' END AS momentum FROM b"""),
)
register(
    "role_performance",
    on_facts(lambda f: R.role_performance(f.groupBy(F.col("segment").alias("role")).agg((F.sum("value") / 1e6).alias("contribution"), (F.stddev_pop("value") / 1e3).alias("variance"), (F.avg("value") / 1e3).alias("efficiency"),
             (F.sum(F.when(F.year("ts") == 1997, F.col("value"))) / F.sum(F.when(F.year("ts") == 1996, F.col("value"))) - 1).alias("growth"))).select("role", F.round("score", 4).alias("score"), "tier")),
    with_facts(f"""
, r AS (SELECT segment AS role, sum(value) / 1e6 AS c, -stddev_pop(value) / 1e3 AS v, avg(value) / 1e3 AS e, sum(CASE WHEN year(ts) = 1997 THEN value END) / sum(CASE WHEN year(ts) = 1996 THEN value END) - 1 AS g FROM facts GROUP BY segment)
, p AS (SELECT role, {" + ".join(f"{w} * (CASE WHEN max({x}) OVER () - min({x}) OVER () <= 1e-9 THEN 50 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) * 100 END)" for w, x in ((0.3, 'g'), (0.25, 'e'), (0.25, 'v'), (0.2, 'c')))} AS score FROM r)
SELECT role, round(score, 4)::DOUBLE AS score, {_TIER.format('score')} AS tier FROM p"""),
)


# Risk and root causes from the series' last changes.
def _signals(s: DataFrame) -> DataFrame:
    d = W.deltas(s)
    wide = d.groupBy("entity").agg(*(F.max(F.when(F.col("metric") == m, F.col("mom"))).alias(n) for m, n in (("recurring_revenue", "revenue_growth_delta"), ("order_count", "conversion_delta"), ("active_customer_count", "traffic_delta"), ("arpu", "ltv_delta"))))
    fit = S.linear_forecast(s.where("metric = 'recurring_revenue'"), horizon=1).select("entity", "slope", F.col("deviation").alias("deviation_percentage"))
    x = wide.join(fit, "entity").withColumns({"churn_delta": -F.col("traffic_delta"), "cac_delta": -F.col("conversion_delta"), "acceleration": F.abs(F.col("ltv_delta"))})
    x = x.withColumns({"aov_delta": F.col("ltv_delta"), "repeat_purchase_delta": F.col("conversion_delta") - F.col("traffic_delta"), "utilization_delta": F.col("conversion_delta"), "revenue_per_employee_delta": F.col("ltv_delta")})
    return x.withColumn("risk_score", R.risk_score(F.col("revenue_growth_delta"), F.col("churn_delta"), F.col("slope") * 10, F.abs(F.col("deviation_percentage")), F.col("acceleration"), F.lit(True)))


_SIG = """
, dl AS (SELECT entity, metric, (value - lag(value) OVER w) / nullif(abs(lag(value) OVER w), 0) AS mom FROM series WINDOW w AS (PARTITION BY entity, metric ORDER BY seq)
  QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
, wd AS (SELECT entity, max(CASE WHEN metric = 'recurring_revenue' THEN mom END) AS rg, max(CASE WHEN metric = 'order_count' THEN mom END) AS cd, max(CASE WHEN metric = 'active_customer_count' THEN mom END) AS td, max(CASE WHEN metric = 'arpu' THEN mom END) AS ld FROM dl GROUP BY entity)
, ft AS (SELECT entity, regr_slope(value, seq) AS slope, regr_slope(value, seq) * max(seq) + regr_intercept(value, seq) AS fitted, arg_max(value, seq) AS last FROM series WHERE metric = 'recurring_revenue' GROUP BY entity)
, sg AS (SELECT *, (last - fitted) / greatest(abs(fitted), 1e-9) AS dev FROM wd JOIN ft USING (entity))
, rk AS (SELECT *, round_even(least(100, greatest(0, (0.25 * (1 - rg) / 2 + 0.25 * (1 - td) / 2 + 0.2 * least(1, greatest(0, -slope * 10)) + 0.15 * least(1, abs(dev)) + 0.15 * least(1, abs(ld))) * 100)), 0)::INT AS risk FROM sg)"""
_LEVEL = "CASE WHEN risk <= 30 THEN 'low' WHEN risk <= 60 THEN 'moderate' WHEN risk <= 80 THEN 'high' ELSE 'critical' END"
_SEV = "CASE WHEN risk > 80 THEN 'critical' WHEN risk > 60 THEN 'high' WHEN risk > 30 THEN 'moderate' ELSE 'low' END"
register(
    "risk_score",
    on_series(lambda s: _signals(s).select("entity", "risk_score", R.risk_level(F.col("risk_score")).alias("level"))),
    with_series(_SIG + f"\nSELECT entity, risk AS risk_score, {_LEVEL} AS level FROM rk"),
)
_CAUSES = {
    "saas": [("retention_issue", "-td > 0 AND rg < 0"), ("acquisition_inefficiency", "-cd > 0 AND rg <= 0"), ("customer_value_decline", "-td > 0 AND ld < 0"), ("negative_growth_trend", "slope < 0 AND dev < 0"), ("high_business_risk", "risk > 70")],
    "ecommerce": [("conversion_problem", "cd < 0 AND td BETWEEN -5 AND 5"), ("pricing_or_product_mix_issue", "ld < 0 AND rg < 0"), ("inefficient_marketing_spend", "-cd > 0 AND cd < 0"), ("retention_problem", "cd - td < 0"), ("downward_sales_trend", "slope < 0"), ("high_business_risk", "risk > 70")],
    "agency": [("client_retention_issue", "-td > 0"), ("underutilization_problem", "cd < 0"), ("productivity_decline", "ld < 0"), ("capacity_misalignment", "rg < 0 AND cd < 0"), ("future_revenue_risk", "slope < 0"), ("high_business_risk", "risk > 70")],
}
for _type, _rules in _CAUSES.items():
    register(
        f"root_cause_{_type}",
        on_series(lambda s, t=_type: R.root_causes(_signals(s), t).select("entity", F.array_join("issues", ",").alias("issues"), "primary_issue", "contributing", "severity")),
        with_series(_SIG + ", iss AS (SELECT entity, risk, concat_ws(',', " + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in _rules) + f""") AS i FROM rk)
SELECT entity, i AS issues, CASE WHEN i = '' THEN 'no_issue_detected' ELSE split_part(i, ',', 1) END AS primary_issue, CASE WHEN contains(i, ',') THEN substr(i, strpos(i, ',') + 1) ELSE '' END AS contributing, {_SEV} AS severity FROM iss"""),
    )
register(
    "prioritization",
    on_series(lambda s: _signals(s).select("entity", R.priority(R.risk_severity(F.col("risk_score")), F.when(F.col("slope") < 0, "moderate"), F.when(F.col("revenue_growth_delta") < -0.2, "high")).alias("priority"))),
    with_series(_SIG + f"""
SELECT entity, ['low', 'moderate', 'high', 'critical'][greatest(1, list_position(['low', 'moderate', 'high', 'critical'], {_SEV}), CASE WHEN slope < 0 THEN 2 END, CASE WHEN rg < -0.2 THEN 3 END)] AS priority FROM rk"""),
)
register(
    "signal_conflicts",
    on_series(lambda s: J.signal_conflicts(_signals(s).select("entity", F.inline(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in ("revenue_growth_delta", "churn_delta", "conversion_delta", "slope", "deviation_percentage", "cac_delta", "ltv_delta", "traffic_delta"))))))),
    with_series(_SIG + """
, sl AS (SELECT entity, unnest(['revenue_growth_delta', 'churn_delta', 'conversion_delta', 'slope', 'deviation_percentage', 'cac_delta', 'ltv_delta', 'traffic_delta']) AS s, unnest([rg, -td, cd, slope, dev, -cd, ld, td]) AS v FROM sg)
, sn AS (SELECT entity, s, CASE WHEN v > 1e-9 THEN 1 WHEN v < -1e-9 THEN -1 ELSE 0 END AS d FROM sl WHERE v IS NOT NULL)
, ru(a, b, e, w) AS (VALUES ('revenue_growth_delta', 'churn_delta', 'opposite', 0.9), ('revenue_growth_delta', 'conversion_delta', 'same', 0.7), ('traffic_delta', 'revenue_growth_delta', 'same', 0.6), ('churn_delta', 'active_customer_delta', 'opposite', 0.8),
  ('slope', 'deviation_percentage', 'same', 0.5), ('revenue_growth_delta', 'cac_delta', 'opposite', 0.6), ('conversion_delta', 'churn_delta', 'opposite', 0.7), ('ltv_delta', 'churn_delta', 'opposite', 0.8), ('revenue_growth_delta', 'slope', 'same', 0.6),
  ('revenue_growth_delta', 'active_customer_delta', 'same', 0.7), ('ltv_delta', 'cac_delta', 'opposite', 0.7))
, ev AS (SELECT x.entity, w::DOUBLE AS w, x.d * y.d <> 0 AND CASE WHEN e = 'same' THEN x.d <> y.d ELSE x.d = y.d END AS c FROM ru JOIN sn x ON x.s = a JOIN sn y ON y.s = b AND y.entity = x.entity)
SELECT entity, count(*) AS rules_evaluated, count(CASE WHEN c THEN 1 END) AS conflicts, round(coalesce(sum(CASE WHEN c THEN w END), 0), 6) AS total_severity,
  round(least(0.6, coalesce(sum(CASE WHEN c THEN w END), 0) * 0.12), 6)::DOUBLE AS penalty, coalesce(max(CASE WHEN c THEN w END), 0) >= 0.8 AS uncertain FROM ev GROUP BY entity"""),
)
register(
    "temporal_conflicts",
    on_series(lambda s: J.temporal_conflicts(S.cross_correlation(s), s)),
    with_series(_TAIL + """
, sh AS (SELECT p.entity, p.a, p.b, l.lag, p.x, q.y FROM pr p, range(-6, 7) l(lag) JOIN pr q ON q.entity = p.entity AND q.a = p.a AND q.b = p.b AND q.back = p.back - l.lag)
, pe AS (SELECT entity, a, b, lag, count(*) AS n, CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r FROM sh GROUP BY ALL HAVING count(*) >= 5)
, best AS (SELECT * FROM pe WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, a, b ORDER BY round(abs(r), 9) DESC, lag) = 1)
, way AS (SELECT entity, metric, sign(max_by(value, seq) - min_by(value, seq)) AS way FROM series GROUP BY ALL)
SELECT c.entity, c.a, c.b, c.lag, round(c.r, 6) AS r, CASE WHEN x.way > 0 THEN 'up' ELSE 'down' END AS way_a, CASE WHEN y.way > 0 THEN 'up' ELSE 'down' END AS way_b
FROM best c JOIN way x ON x.entity = c.entity AND x.metric = c.a JOIN way y ON y.entity = c.entity AND y.metric = c.b
WHERE c.lag <> 0 AND abs(c.r) >= 1.96 / sqrt(c.n::DOUBLE) AND x.way * y.way < 0"""),
)
register(
    "benchmark_snapshot",
    on_series(lambda s: G.benchmark_snapshot(_scores(s).select("entity", "metric", "percentile"))),
    with_series(_SCORES + """
, p AS (SELECT entity, metric, below / n::DOUBLE * 100 AS percentile FROM scores)
, k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(percentile, 9), metric) AS l, row_number() OVER (PARTITION BY entity ORDER BY round(percentile, 9) DESC, metric) AS h FROM p)
SELECT entity, metric, round(percentile, 6) AS percentile, CASE WHEN percentile < 40 AND l <= 3 THEN 'weak' ELSE 'strong' END AS side FROM k WHERE (percentile < 40 AND l <= 3) OR (percentile >= 60 AND h <= 3)"""),
)


# Segments of customers.
def customer_features(f: DataFrame) -> DataFrame:
    a = f.groupBy("customer").agg(F.count(F.lit(1)).cast("double").alias("orders"), (F.sum("value") / 1e6).alias("ltv"), (F.stddev_pop("value") / F.avg("value")).alias("risk"), F.datediff(F.max("ts"), F.min("ts")).cast("double").alias("tenure"))
    return a


register(
    "feature_matrix",
    on_facts(lambda f: R.standardized(customer_features(f), ("orders", "ltv", "risk", "tenure")).select("customer", *(F.round(c, 4).alias(c) for c in ("orders", "ltv", "risk", "tenure")))),
    with_facts("""
, c AS (SELECT customer, count(*)::DOUBLE AS orders, sum(value) / 1e6 AS ltv, stddev_pop(value) / avg(value) AS risk, date_diff('day', min(ts)::DATE, max(ts)::DATE)::DOUBLE AS tenure FROM facts GROUP BY customer)
SELECT customer, round((orders - avg(orders) OVER ()) / stddev_pop(orders) OVER (), 4) AS orders, round((ltv - avg(ltv) OVER ()) / stddev_pop(ltv) OVER (), 4) AS ltv,
  round((risk - avg(risk) OVER ()) / stddev_pop(risk) OVER (), 4) AS risk, round((tenure - avg(tenure) OVER ()) / stddev_pop(tenure) OVER (), 4) AS tenure FROM c"""),
)


def kmeans_segments(spark, sf_dir):
    f = customer_features(star.facts(spark, sf_dir))
    labelled = R.kmeans_segments(f, ("orders", "ltv", "risk", "tenure"))
    return rounded(labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *(F.avg(c).alias(f"avg_{c}") for c in ("orders", "ltv", "risk", "tenure"))))


register("kmeans_segments", kmeans_segments)
register(
    "segment_labels",
    on_series(lambda s: _frame(s).select("entity", R.segment_label(F.col("growth"), F.greatest(F.lit(0.0), -F.col("growth")), F.col("risk")).alias("label"))),
    with_series(_GROW + """
, f AS (SELECT entity, arg_max(g, seq) AS growth, stddev_pop(value) / avg(value) AS risk FROM gr WHERE metric = 'recurring_revenue' GROUP BY entity)
SELECT entity, CASE WHEN growth > 0.1 AND greatest(0, -growth) <= 0.05 AND risk <= 0.3 THEN 'High Value / Growth Segment' WHEN growth <= 0 AND greatest(0, -growth) > 0.1 THEN 'At Risk Segment'
  WHEN growth < 0 AND risk > 0.6 THEN 'Declining Segment' WHEN growth BETWEEN 0 AND 0.1 AND risk <= 0.6 THEN 'Stable Segment' ELSE 'Unclassified Segment' END AS label FROM f"""),
)

