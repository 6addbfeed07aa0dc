"""Queries of projections, scenarios, confidence and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.functions import columns as C
from tallygrove.operators import confidence as G
from tallygrove.operators import scenarios as N
from tallygrove.operators import series as S
from tallygrove.operators import windows as W
from tallygrove.plans.registry import on_series, register, with_series

_S = "PARTITION BY entity, metric ORDER BY seq"
_REV = """
, rv AS (SELECT entity AS client, seq, ts, value, (value - lag(value) OVER w) / greatest(abs(lag(value) OVER w), 1e-9) AS g FROM series WHERE metric = 'recurring_revenue' WINDOW w AS (PARTITION BY entity ORDER BY seq))
, cl AS (SELECT client, arg_max(value, seq) AS last_value, max(ts) AS last_date, least(0.2, greatest(-0.2, arg_max(g, seq))) AS growth FROM rv GROUP BY client)"""


def _clients(s: DataFrame) -> DataFrame:
    g = W.growth(s.where("metric = 'recurring_revenue'"))
    c = g.groupBy(F.col("entity").alias("client")).agg(F.max_by("value", "seq").alias("last_value"), F.max("ts").alias("last_date"), C.clip(F.max_by("growth", "seq"), -0.2, 0.2).alias("growth"))
    return c.withColumns({"industry": F.lit(0.02), "gdp": F.when(F.length("client") % 2 == 0, F.lit(0.01))})


def _projected(s: DataFrame) -> DataFrame:
    return N.base_projection(_clients(s))


_PROJ = _REV + """
, bl AS (SELECT *, (0.6 * growth + 0.3 * 0.02 + CASE WHEN length(client) % 2 = 0 THEN 0.1 * 0.01 ELSE 0 END) / (0.6 + 0.3 + CASE WHEN length(client) % 2 = 0 THEN 0.1 ELSE 0 END) AS g FROM cl)
, pj AS (SELECT client, q AS quarter, last_day(last_date + to_months((3 * q)::INT)) AS period_end, g AS blended, last_value * pow(1 + g, q) AS revenue FROM bl, range(1, 9) t(q))"""
register(
    "base_projection",
    on_series(_projected),
    with_series(_PROJ + "\nSELECT client, quarter::INT AS quarter, period_end::DATE AS period_end, round(blended, 6)::DOUBLE AS blended, round(revenue, 6) AS revenue FROM pj"),
)
register(
    "growth_blend",
    on_series(lambda s: _clients(s).select("client", N.blend([(F.col("growth"), 0.6), (F.col("industry"), 0.3), (F.col("gdp"), 0.1)]).alias("blended"))),
    with_series(_PROJ + "\nSELECT client, round(g, 6)::DOUBLE AS blended FROM bl"),
)
register(
    "projection_from_growth_path",
    on_series(lambda s: N.project_from_growth(_clients(s).withColumn("path", F.array(F.col("growth"), F.lit(None).cast("double"), F.lit(0.1), F.lit(-0.05))), "last_value", "path").select(
        "client", *(F.get("projected", F.lit(i)).alias(f"q{i + 1}") for i in range(4)))),
    with_series(_REV + "\nSELECT client, round(last_value * (1 + growth), 6) AS q1, NULL::DOUBLE AS q2, round(last_value * (1 + growth) * 1.1::DOUBLE, 6) AS q3, round(last_value * (1 + growth) * 1.1::DOUBLE * 0.95::DOUBLE, 6) AS q4 FROM cl"),
)


def _erosion(s: DataFrame, exponential: bool = False) -> DataFrame:
    x = _clients(s).select("client", (F.length("client") * 4).cast("double").alias("share"), (F.length("client") * 6).cast("double").alias("score"), F.lit(0.03).alias("industry_growth"), F.lit(0.1).alias("factor"))
    return N.erosion(x, 8, "severe", exponential)


_ERO = _REV + """
, ei AS (SELECT client, length(client) * 4.0::DOUBLE AS share, least(0.95, greatest(0, 0.1 * round((100 - least(100, length(client) * 6)) / 100.0, 6) * 1.35))::DOUBLE AS e FROM cl)
, ef AS (SELECT *, CASE WHEN share > 1 AND share <= 100 THEN share / 100 ELSE least(1, share) END AS f FROM ei)
, eq AS (SELECT client, share, f, q AS quarter, least(0.99, greatest(0, {0}))::DOUBLE AS erosion FROM ef, range(1, 9) t(q))
, es AS (SELECT *, erosion - coalesce(lag(erosion) OVER (PARTITION BY client ORDER BY quarter), 0) AS d, greatest(0.03::DOUBLE * (1 - erosion), -0.95) AS growth FROM eq)
, er AS (SELECT *, least(1, greatest(0, f * exp(sum(ln(1 - d)) OVER (PARTITION BY client ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))) AS s FROM es)"""
for _name, _exp, _sql in (("erosion_curve", False, "e * q"), ("erosion_curve_exponential", True, "1 - exp(-e * q)")):
    register(
        _name,
        on_series(lambda s, e=_exp: _erosion(s, e).select("client", "quarter", "erosion", "growth", "share")),
        with_series(_ERO.format(_sql) + "\nSELECT client, quarter, round(erosion, 6) AS erosion, round(growth, 6) AS growth, round(CASE WHEN share > 1 THEN s * 100 ELSE s END, 6) AS share FROM er"),
    )
register(
    "erosion_impact",
    on_series(lambda s: N.erosion_impact(_erosion(s))),
    with_series(_ERO.format("e * q") + """
, im AS (SELECT client, 0.03::DOUBLE AS b, avg(growth) AS g, max(f) AS f, arg_max(s, quarter) AS e FROM er GROUP BY client)
SELECT client, round(greatest(0, 0.5 * (b - g) / greatest(abs(b), 1e-9) + 0.5 * (f - e) / greatest(abs(f), 1e-9)) * 100, 6) AS impact_pct FROM im"""),
)


def _stressed(s: DataFrame, curve: str) -> DataFrame:
    m = C.shock_multiplier(F.lit(3.0), F.lit(2.0), F.length("client") / 2)
    return N.recession(_projected(s).withColumn("multiplier", m), curve)


_REC = _PROJ + """
, mu AS (SELECT *, least(1, greatest(0.35, 1 - length(client) / 2.0 * (0.65 * 0.03 + 0.35 * 0.02)))::DOUBLE AS t FROM pj)
, st AS (SELECT *, CASE WHEN quarter <= 2 THEN 1 + (t - 1) * (quarter - 1) WHEN quarter <= 2 + {1} THEN t ELSE {2} END AS m FROM mu)"""
for _curve, (_rec, _plat, _target) in N.CURVES.items():
    _ramp = f"t + ({_target} - t) * least(1, (quarter - 2 - {_plat}) / {float(_rec)})"
    _ramp = f"least({_ramp}, {_target})" if _curve == "l_shape" else _ramp
    register(
        f"recession_{_curve}",
        on_series(lambda s, c=_curve: _stressed(s, c)),
        with_series(_REC.format("", _plat, _ramp) + "\nSELECT client, quarter, round(revenue, 6) AS revenue, round(m, 6)::DOUBLE AS recovery, round(revenue * m, 6)::DOUBLE AS stressed FROM st"),
    )
register(
    "recession_impact",
    on_series(lambda s: N.recession_impact(_stressed(s, "u_shape"))),
    with_series(_REC.format("", 1, "t + (1.0 - t) * least(1, (quarter - 2 - 1) / 4.0)") + """
, a AS (SELECT client, sum(revenue) AS b, sum(revenue * m) AS s, min(CASE WHEN quarter > 2 AND abs(revenue) > 1e-12 AND revenue * m / revenue >= 0.98 THEN quarter END) AS q FROM st GROUP BY client)
SELECT client, round((s - b) / greatest(abs(b), 1e-9) * 100, 6)::DOUBLE AS net_impact_pct, CASE WHEN q IS NULL THEN 'not_recovered_within_horizon' ELSE q::VARCHAR || 'Q' END AS recovery_time FROM a"""),
)
register(
    "macro_shock_inputs",
    on_series(lambda s: N.macro_shock(s.where("metric in ('recurring_revenue', 'arpu')").select(
        "entity", F.when(F.col("metric") == "arpu", "policy_rate").otherwise("gdp").alias("metric"), F.col("ts").alias("period_end"), "value"), ("entity",))),
    with_series("""
, r AS (SELECT entity, metric, seq, CASE WHEN abs(value) >= 1 AND abs(value) <= 500 THEN value / 100 ELSE value END AS v FROM series WHERE metric IN ('recurring_revenue', 'arpu'))
, l AS (SELECT *, lag(v) OVER (PARTITION BY entity, metric ORDER BY seq) AS p FROM r QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
SELECT entity, round(max(CASE WHEN metric = 'recurring_revenue' THEN greatest(0, -(v - p) / greatest(abs(p), 1e-12)) END), 6) AS gdp_contraction, round(max(CASE WHEN metric = 'arpu' THEN greatest(0, v - p) END), 6) AS rate_spike FROM l WHERE p IS NOT NULL GROUP BY entity"""),
)


def _rivals(s: DataFrame) -> DataFrame:
    """Three competitors per client with rates that are shorter than the horizon or percentages."""
    names = F.array(*(F.struct(F.lit(n).alias("competitor"), F.array(*map(F.lit, rates)).alias("rates")) for n, rates in (("a", [0.02]), ("b", [2.0, 3.0]), ("c", [0.1, 0.05, -0.02]))))
    return N.competitor_growth(_clients(s).select("client", F.inline(names)), "rates", 8)


def _industry(s: DataFrame) -> DataFrame:
    """Two to six times a client's revenue, or nothing."""
    return _clients(s).select("client", (F.col("last_value") * F.when(F.substring("client", 8, 10).cast("int") % 6 == 0, 0).otherwise(1 + F.substring("client", 8, 10).cast("int") % 6)).alias("industry"))


def _shares(s: DataFrame, scenario: str) -> DataFrame:
    return N.market_share(_projected(s).select("client", "quarter", "revenue"), _rivals(s), _industry(s), scenario, 0.15, 0.02)


_RIV = _PROJ + """
, cm(c, r1, r2, r3) AS (VALUES ('a', 0.02, 0.02, 0.02), ('b', 0.02, 0.03, 0.03), ('c', 0.1, 0.05, -0.02))
, rq AS (SELECT client, c, q AS quarter, (CASE q WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r3 END)::DOUBLE AS rate FROM cl, cm, range(1, 9) t(q))"""
register(
    "competitor_growth_paths",
    on_series(lambda s: _rivals(s).select("client", "competitor", "quarter", "rate")),
    with_series(_RIV + "\nSELECT client, c AS competitor, quarter, round(rate, 6) AS rate FROM rq"),
)
_SHARE = _RIV + """
, ow AS (SELECT client, quarter, greatest(revenue, 0) * {0}::DOUBLE AS own FROM pj)
, fi AS (SELECT client, last_value * CASE WHEN CAST(substr(client, 8) AS INT) % 6 = 0 THEN 0 ELSE 1 + CAST(substr(client, 8) AS INT) % 6 END AS size, arg_min(own, quarter) AS o FROM ow JOIN cl USING (client) GROUP BY client, last_value)
, po AS (SELECT *, greatest(0, CASE WHEN greatest(size, o) > 0 THEN greatest(size, o) ELSE 1 END - o) AS pool FROM fi)
, lv AS (SELECT client, quarter, pool / 3 * exp(sum(ln(1 + greatest(rate * {1}::DOUBLE, -0.95))) OVER (PARTITION BY client, c ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS level FROM rq JOIN po USING (client))
, ag AS (SELECT client, quarter, any_value(own) AS own, sum(level) AS rivals, count(CASE WHEN round(level, 9) > round(own, 9) THEN 1 END) AS above, any_value(size) * pow(1 + 0.02::DOUBLE * {2}::DOUBLE, quarter) AS size FROM lv JOIN ow USING (client, quarter) JOIN po USING (client) GROUP BY client, quarter)
, en AS (SELECT *, 0.15::DOUBLE * {3}::DOUBLE * size AS entrant FROM ag)
, sh AS (SELECT client, quarter, own / greatest(size, own + rivals + entrant) AS share, 1 + above + CASE WHEN round(entrant, 9) > round(own, 9) THEN 1 ELSE 0 END AS rank, max(entrant) OVER (PARTITION BY client) > 0 AS active FROM en)"""
for _sc, _k4 in N.ASSUMPTIONS.items():
    register(
        f"market_share_{_sc}",
        on_series(lambda s, sc=_sc: _shares(s, sc)),
        with_series(_SHARE.format(*_k4) + """
SELECT client, quarter, round(share, 6) AS share, rank, round(share - first_value(share) OVER (PARTITION BY client ORDER BY quarter), 6) AS share_change, active AS entrant_active FROM sh"""),
    )
register(
    "competitive_shift_index",
    on_series(lambda s: N.competitive_shift(_shares(s, "aggressive"), _rivals(s))),
    with_series(_SHARE.format(*N.ASSUMPTIONS["aggressive"]) + """
, fl AS (SELECT client, arg_min(share, quarter) AS s0, arg_max(share, quarter) AS s1, arg_min(rank, quarter) AS r0, arg_max(rank, quarter) AS r1, bool_or(active)::INT AS e FROM sh GROUP BY client)
SELECT client, round((s1 - s0) * 100, 6)::DOUBLE AS share_delta, round(0.5 * (r0 - r1) / (3 + e) + 0.5 * (s1 - s0) / greatest(abs(s0), 1e-9), 6)::DOUBLE AS shift_index FROM fl"""),
)


def _grid(s: DataFrame) -> DataFrame:
    flags = S.anomaly_flags(s.where("metric = 'recurring_revenue'")).groupBy("entity").agg(F.count(F.when(F.col("is_iqr"), 1)).alias("a"), F.max_by("value", "seq").alias("latest"), F.count(F.lit(1)).alias("n"))
    g = W.latest(W.growth_signals(s.where("metric = 'recurring_revenue'"))).select("entity", F.col("short_growth").alias("growth"))
    x = flags.join(g, "entity").select("entity", "latest", "growth", F.least(F.lit(0.2), F.col("a") * 0.01).alias("anomaly_penalty"), F.lit(0.1).alias("correlation_penalty"), G.depth_score(F.col("n")).alias("confidence"))
    return N.scenario_grid(x)


_GRID = f"""
, q AS (SELECT *, value < quantile_cont(value, 0.25) OVER w - 1.5 * (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) OR value > quantile_cont(value, 0.75) OVER w + 1.5 * (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) AS out,
    lag(value, 3) OVER ({_S}) AS l3 FROM series WHERE metric = 'recurring_revenue' WINDOW w AS (PARTITION BY entity))
, f AS (SELECT entity, count(CASE WHEN out THEN 1 END) AS a, arg_max(value, seq) AS latest, count(*) AS n, arg_max((value - l3) / greatest(abs(l3), 1e-9), seq) AS growth FROM q GROUP BY entity)
, sk(scenario, dg, dl, vm, dc) AS (VALUES ('best', 0.04, 0.02, 0.8, 0.05), ('base', 0.0, 0.0, 1.0, 0.0), ('worst', -0.05, -0.03, 1.3, -0.08))
, gd AS (SELECT entity, scenario, coalesce(growth, 0) + dg::DOUBLE - least(0.2, a * 0.01)::DOUBLE * vm::DOUBLE AS g, latest, dl, least(1, greatest(0.2, CASE WHEN n < 3 THEN 0 ELSE least(1, ln(n::DOUBLE) / ln(12::DOUBLE)) END + dc::DOUBLE - 0.05)) AS c FROM f, sk)"""
register(
    "scenario_grid",
    on_series(_grid),
    with_series(_GRID + "\nSELECT entity, scenario, round(g, 6) AS projected_growth, round(latest * (1 + g + dl::DOUBLE), 6) AS projected_value, round(c, 6)::DOUBLE AS confidence FROM gd"),
)
register(
    "scenario_snapshot",
    on_series(lambda s: G.scenario_snapshot(_grid(s))),
    with_series(_GRID + """
SELECT entity, round(max(CASE WHEN scenario = 'best' THEN g END), 6) AS best_growth, round(max(CASE WHEN scenario = 'worst' THEN g END), 6) AS worst_growth, round(max(CASE WHEN scenario = 'base' THEN c END), 6)::DOUBLE AS base_confidence FROM gd GROUP BY entity"""),
)


def _cases(s: DataFrame) -> DataFrame:
    e = _erosion(s).select("client", "quarter", "erosion")
    return N.orchestrate(_projected(s).join(e, ["client", "quarter"]).withColumn("multiplier", F.lit(0.8)))


_ORCH = _ERO.format("e * q") + """
, bl AS (SELECT *, (0.6 * growth + 0.3 * 0.02 + CASE WHEN length(client) % 2 = 0 THEN 0.1 * 0.01 ELSE 0 END) / (0.6 + 0.3 + CASE WHEN length(client) % 2 = 0 THEN 0.1 ELSE 0 END) AS g FROM cl)
, pj AS (SELECT client, q AS quarter, last_value * pow(1 + g, q) AS revenue FROM bl, range(1, 9) t(q))
, mm AS (SELECT p.client, p.quarter, p.revenue, r.erosion, CASE WHEN p.quarter <= 2 THEN 1 + (0.8 - 1) * (p.quarter - 1) WHEN p.quarter <= 3 THEN 0.8 ELSE 0.8 + 0.2 * least(1, (p.quarter - 3) / 4.0) END AS m FROM pj p JOIN er r USING (client, quarter))
, cs AS (SELECT client, quarter, revenue AS base, unnest(['base', 'erosion', 'recession', 'combined']) AS "case", unnest([revenue, revenue * (1 - erosion), revenue * m, revenue * (1 - erosion) * m]) AS value FROM mm)"""
register(
    "scenario_orchestration",
    on_series(_cases),
    with_series(_ORCH + '\nSELECT client, quarter, round(base, 6) AS base, "case", round(value, 6)::DOUBLE AS value FROM cs'),
)
register(
    "scenario_risk",
    on_series(lambda s: N.scenario_risk(_cases(s).where("case = 'combined'").select("client", "quarter", "base", F.col("value").alias("scenario")))),
    with_series(_ORCH + """
, x AS (SELECT *, (value - base) / greatest(abs(base), 1e-9) AS rel, max(value) OVER (PARTITION BY client ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM cs WHERE "case" = 'combined')
, a AS (SELECT client, avg(greatest(0, -rel)) AS d, avg(greatest(0, rel)) AS u, max(greatest(0, (peak - value) / greatest(abs(peak), 1e-9))) AS w FROM x GROUP BY client)
SELECT client, round(d, 6)::DOUBLE AS downside, round(u, 6)::DOUBLE AS upside, round(w, 6)::DOUBLE AS drawdown, round(least(100, greatest(0, (0.7 * d + 0.3 * w - 0.4 * u) * 100)), 6)::DOUBLE AS risk FROM a"""),
)

# Confidence and gates.
def _k() -> Column:
    """A number of each entity, so that inputs differ from entity to entity."""
    return F.substring("entity", 8, 10).cast("int")


_CONF = """
, rs AS (SELECT *, value - (avg(value) OVER w + coalesce(regr_slope(value, seq) OVER w, 0) * (seq - avg(seq) OVER w)) AS residual, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3, count(*) OVER w AS nn,
    row_number() OVER (PARTITION BY entity, metric ORDER BY seq) - 1 AS i FROM series WINDOW w AS (PARTITION BY entity, metric))
, fl AS (SELECT *, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS o FROM rs)
, ag AS (SELECT entity, metric, count(*) AS n, stddev_pop(residual) / greatest(abs(avg(value)), 1e-9) AS cv, count(CASE WHEN o THEN 1 END) AS outliers, count(CASE WHEN o AND i >= greatest(1, floor(nn * 0.8)) THEN 1 END) AS ro,
    avg(CASE WHEN i < greatest(1, nn // 3) THEN value END) AS e, avg(CASE WHEN i >= nn - greatest(1, nn // 3) THEN value END) AS l FROM fl GROUP BY entity, metric)
, sc AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE least(1, ln(n::DOUBLE) / ln(12::DOUBLE)) END AS depth, greatest(0.3, least(1, 1 - cv / 2)) AS vol, CASE WHEN n < 4 THEN 1 ELSE greatest(0, 1 - least(0.5, outliers * 0.08)) END AS ano FROM ag)"""
register(
    "confidence_depth_anomaly",
    on_series(G.series_confidence),
    with_series(_CONF + """
SELECT entity, metric, n, round(cv, 6) AS cv, outliers, round(depth, 6)::DOUBLE AS depth, round(vol, 6)::DOUBLE AS volatility, round(ano, 6)::DOUBLE AS anomaly, 1.0::DOUBLE AS consistency,
  round(CASE WHEN depth = 0 THEN 0 ELSE exp((ln(greatest(depth, 1e-9)) + ln(greatest(vol, 1e-9)) + ln(greatest(ano, 1e-9))) / 4) END, 6)::DOUBLE AS confidence,
  CASE WHEN n < 3 THEN 'insufficient_data' WHEN ro > 0 THEN 'sudden_spike' WHEN l > e AND NOT (cv > 0.15 OR vol < 0.85) THEN 'stable_growth' WHEN l > e THEN 'volatile_growth'
    WHEN l < e AND NOT (cv > 0.15 OR vol < 0.85) THEN 'stable_decline' WHEN l < e THEN 'volatile_decline' ELSE 'neutral' END AS pattern FROM sc"""),
)


def _patterned(s: DataFrame) -> DataFrame:
    """Each series with its changes over one and over three periods, and its slope for some, as signals."""
    d = W.deltas(s).select("entity", "metric", F.inline(F.array(F.struct(F.lit("mom").alias("signal"), F.col("mom").alias("value")), F.struct(F.lit("qoq").alias("signal"), F.when(_k() % 6 != 0, F.col("qoq")).alias("value")))))
    return G.series_confidence(s, signals=d).select("entity", "metric", "consistency", "confidence", "pattern")


register(
    "signal_patterns",
    on_series(_patterned),
    with_series(_CONF + """
, dl AS (SELECT entity, metric, (value - lag(value) OVER w) / nullif(abs(lag(value) OVER w), 0) AS m, CASE WHEN CAST(substr(entity, 8) AS INT) % 6 <> 0 THEN (value - lag(value, 3) OVER w) / nullif(abs(lag(value, 3) OVER w), 0) END AS q FROM series WINDOW w AS (PARTITION BY entity, metric ORDER BY seq)
  QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
, cs AS (SELECT *, coalesce(m * q < 0 AND abs(m) > 1e-9 AND abs(q) > 1e-9, false) AS c FROM sc JOIN dl USING (entity, metric))
SELECT entity, metric, CASE WHEN c THEN 0.85 ELSE 1 END::DOUBLE AS consistency,
  round(CASE WHEN depth = 0 THEN 0 ELSE exp((ln(greatest(depth, 1e-9)) + ln(greatest(vol, 1e-9)) + ln(greatest(ano, 1e-9)) + ln(CASE WHEN c THEN 0.85 ELSE 1 END::DOUBLE)) / 4) END, 6)::DOUBLE AS confidence,
  CASE WHEN n < 3 THEN 'insufficient_data' WHEN c THEN 'conflicting_indicators' WHEN ro > 0 THEN 'sudden_spike' WHEN l > e AND NOT (cv > 0.15 OR vol < 0.85) THEN 'stable_growth' WHEN l > e THEN 'volatile_growth'
    WHEN l < e AND NOT (cv > 0.15 OR vol < 0.85) THEN 'stable_decline' WHEN l < e THEN 'volatile_decline' ELSE 'neutral' END AS pattern FROM cs"""),
)


def _gated(s: DataFrame) -> DataFrame:
    c = G.series_confidence(s).select("entity", "metric", "n", "confidence")
    up = F.avg("confidence").over(W.whole(("entity",)))
    return c.select("entity", "metric", G.propagated(F.col("confidence"), F.lit(0.9), up, F.min("confidence").over(W.whole(("entity",)))).alias("confidence"), F.col("n"))


_GATED = _CONF + """
, cf AS (SELECT entity, metric, n, CASE WHEN depth = 0 THEN 0 ELSE exp((ln(greatest(depth, 1e-9)) + ln(greatest(vol, 1e-9)) + ln(greatest(ano, 1e-9))) / 4) END AS c FROM sc)
, pr AS (SELECT entity, metric, n, least(1, greatest(0, CASE WHEN min(c) OVER w < 0.15 THEN least(0.4, 0.6 * c + 0.18 + 0.2 * avg(c) OVER w) ELSE 0.6 * c + 0.18 + 0.2 * avg(c) OVER w END)) AS p FROM cf WINDOW w AS (PARTITION BY entity))"""
register(
    "propagated_confidence",
    on_series(_gated),
    with_series(_GATED + "\nSELECT entity, metric, n, round(p, 6)::DOUBLE AS confidence FROM pr"),
)

_LAYERS = {"recurring_revenue": "kpi", "order_count": "forecast", "active_customer_count": "competitive", "arpu": "cohort"}


def _signals(s: DataFrame) -> DataFrame:
    """entity, metric, layer, score, status and gate of signals of every kind of status, none for some."""
    status = (
        F.when((F.col("metric") == "arpu") & (_k() % 2 == 0), "insufficient_data").when((F.col("metric") == "order_count") & (_k() % 5 == 0), "failed")
        .when(_k() % 3 == 0, "Partial ").otherwise("success")
    )
    score = F.greatest(F.lit(0.0), F.col("confidence") - (_k() % 12) / 12)
    layer = F.element_at(F.create_map(*(F.lit(x) for kv in _LAYERS.items() for x in kv)), F.col("metric"))
    x = _gated(s).where(~((F.col("metric") == "active_customer_count") & (_k() % 4 == 1))).select("entity", "metric", layer.alias("layer"), score.alias("score"), status.alias("status"))
    return x.withColumn("gate", G.gate(F.col("status"), F.col("score")))


_SIGNALS = _GATED + """
, kk AS (SELECT *, CAST(substr(entity, 8) AS INT) AS k FROM pr)
, sg AS (SELECT entity, metric, k, CASE metric WHEN 'recurring_revenue' THEN 'kpi' WHEN 'order_count' THEN 'forecast' WHEN 'active_customer_count' THEN 'competitive' ELSE 'cohort' END AS layer, greatest(0, p - (k % 12) / 12.0) AS s,
    CASE WHEN metric = 'arpu' AND k % 2 = 0 THEN 'insufficient_data' WHEN metric = 'order_count' AND k % 5 = 0 THEN 'failed' WHEN k % 3 = 0 THEN 'partial' ELSE 'success' END AS st FROM kk WHERE NOT (metric = 'active_customer_count' AND k % 4 = 1))
, gt AS (SELECT *, CASE WHEN st = 'failed' THEN 'block' WHEN s < 0.2 AND st <> 'success' THEN 'isolate' WHEN st = 'insufficient_data' OR s < 0.3 THEN 'degrade' ELSE 'pass' END AS gate FROM sg)"""
register(
    "signal_gates",
    on_series(lambda s: _signals(s).select("entity", "metric", "gate", G.eligible(F.col("gate")).alias("eligible"))),
    with_series(_SIGNALS + "\nSELECT entity, metric, gate, gate IN ('pass', 'degrade') AS eligible FROM gt"),
)
register(
    "layer_states",
    on_series(lambda s: G.layer_states(_signals(s).select("entity", "layer", "score", "gate"))),
    with_series(_SIGNALS + """
SELECT e.entity, l.layer, CASE WHEN gate IS NULL THEN 'missing' WHEN gate IN ('block', 'isolate') THEN 'isolated' WHEN gate = 'degrade' THEN 'degraded' WHEN s >= 0.01 THEN 'valid' ELSE 'inactive' END AS state
FROM (SELECT DISTINCT entity FROM gt) e CROSS JOIN (SELECT unnest(['kpi', 'cohort', 'segmentation', 'competitive', 'forecast']) AS layer) l LEFT JOIN gt ON gt.entity = e.entity AND gt.layer = l.layer"""),
)


def _integrity(s: DataFrame) -> DataFrame:
    x = _signals(s).select("entity", "layer", "score", "gate")
    return G.unified_integrity(x, x.select("entity", (_k() % 6).alias("missing")).distinct())


_INTEGRITY = _SIGNALS + """
, lw AS (SELECT *, gate IN ('pass', 'degrade') AND s >= 0.01 AS v, CASE layer WHEN 'kpi' THEN 1.0 WHEN 'cohort' THEN 0.8 WHEN 'competitive' THEN 0.5 ELSE 0.4 END::DOUBLE * CASE WHEN gate = 'degrade' THEN 0.5 ELSE 1 END AS w FROM gt)
, la AS (SELECT entity, any_value(k) AS k, coalesce(sum(CASE WHEN v THEN w * s END) / sum(CASE WHEN v THEN w END), 0) AS raw, count(CASE WHEN v THEN 1 END)::INT AS valid, max(CASE WHEN layer = 'kpi' THEN s END) AS kpi,
    bool_or(layer = 'kpi' AND gate = 'degrade') AS kd, bool_or(layer = 'forecast' AND gate IN ('pass', 'degrade')) AS fu FROM lw GROUP BY entity)
, lc AS (SELECT *, least(1, raw * CASE WHEN kpi < 0.3 THEN (kpi / 0.3) ** 2 ELSE 1 END) AS x FROM la)
, it AS (SELECT *, least(x, CASE WHEN kd THEN 0.35 ELSE 1 END, CASE WHEN fu THEN 1 ELSE 0.30 END, CASE WHEN valid < 3 THEN 0.25 ELSE 1 END) * greatest(0.5, 1 - 0.15 * (k % 6)) AS integrity,
    CASE WHEN valid = 0 OR kpi = 0 THEN 'blocked' WHEN valid < 3 THEN 'partial_insight' ELSE 'full_insight' END AS quality FROM lc)"""
register(
    "unified_integrity",
    on_series(_integrity),
    with_series(_INTEGRITY + """
SELECT entity, valid AS valid_layers, kpi >= 0.3 AS kpi_gate_passed, kd AS kpi_degraded, fu AS forecast_usable, quality, round(integrity, 6)::DOUBLE AS integrity FROM it"""),
)


def _audited(s: DataFrame) -> DataFrame:
    coverage, severity = (_k() % 5) / 4, (_k() % 7) * 0.3
    caps = G.capped(F.lit(0.9), F.col("kpi_degraded"), F.col("forecast_usable"), F.col("valid_layers"))
    return _integrity(s).select("entity", G.audit(_k() % 4, F.col("valid_layers"), coverage, severity).alias("audit"), G.blocking_conflicts(severity, severity / 2, _k() % 5).alias("conflicts_block"), caps.alias("capped"))


register(
    "synthesis_audit",
    on_series(_audited),
    with_series(_INTEGRITY + """
SELECT entity, CASE WHEN k % 4 = 0 OR valid = 0 OR k % 5 = 0 THEN 'blocked' WHEN k % 4 < 3 OR (k % 5) / 4.0 < 0.5 OR (k % 7) * 0.3 > 1.0 OR valid < 3 THEN 'degraded' ELSE 'pass' END AS audit,
  ((k % 7) * 0.15 >= 0.8 AND (k % 7) * 0.3 >= 1.0) OR k % 5 >= 3 AS conflicts_block,
  round(least(0.9, CASE WHEN kd THEN 0.35 ELSE 1 END, CASE WHEN fu THEN 1 ELSE 0.30 END, CASE WHEN valid < 3 THEN 0.25 ELSE 1 END), 6)::DOUBLE AS capped FROM it"""),
)

# Inputs of a forecast's checks: fit from the series, the rest by entity.
_FIT = """
, ft AS (SELECT entity, metric, CAST(substr(entity, 8) AS INT) AS k, coalesce(regr_slope(value, seq), 0) AS slope, var_pop(value) AS vy, var_pop(seq) AS vx FROM series GROUP BY entity, metric)
, fr AS (SELECT *, CASE WHEN vy < 1e-9 THEN 0 ELSE greatest(0, 1 - (vy - slope * slope * vx) / greatest(vy, 1e-9)) END AS r2, ['low', 'normal', 'high', 'insufficient_history', 'strange'][1 + k % 5] AS regime,
    ['ok', 'ok', 'ok', 'insufficient_data', 'failed'][1 + (k + length(metric)) % 5] AS st, (k % 11) / 10.0 AS c FROM ft)"""


def _fits(s: DataFrame) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (1 + i % len(values)).cast("int"))
    return S.ols(s).select(
        "entity", "metric", "slope", "r_squared", pick(("low", "normal", "high", "insufficient_history", "strange"), _k()).alias("regime"),
        pick(("ok", "ok", "ok", "insufficient_data", "failed"), _k() + F.length("metric")).alias("status"), ((_k() % 11) / 10).alias("c"),
    )


register(
    "forecast_guardrail",
    on_series(lambda s: _fits(s).select("entity", "metric", G.forecast_guardrail(F.col("status"), _k() % 9 + 3, F.when(_k() % 8 == 7, "minimal").otherwise("standard"), F.col("r_squared") * 20, F.col("c"), F.col("regime")).alias("decision"))),
    with_series(_FIT + """
, ad AS (SELECT *, c * CASE regime WHEN 'low' THEN 1.0 WHEN 'normal' THEN 0.92 WHEN 'high' THEN 0.75 WHEN 'insufficient_history' THEN 0.80 ELSE 0.85 END AS a FROM fr)
SELECT entity, metric, CASE WHEN st <> 'ok' THEN 'status_not_ok' WHEN k % 9 + 3 < 6 THEN 'below_reliable_datapoint_threshold' WHEN k % 8 = 7 THEN 'minimal_tier_rejected' WHEN r2 * 20 < 0.30 THEN 'poor_regression_fit'
  WHEN a < CASE WHEN regime = 'high' THEN 0.40 ELSE 0.30 END THEN 'volatility_adjusted_low_confidence' ELSE 'accepted' END AS decision FROM ad"""),
)


def _layer_scores(s: DataFrame) -> DataFrame:
    x = _fits(s).where("metric in ('arpu', 'order_count')")
    horizon, growth = F.when(_k() % 2 == 0, _k() % 7), (_k() % 3 - 1).cast("double")
    parts = {
        "forecast": G.forecast_layer(F.col("status"), _k() % 9 + 3, F.col("r_squared") * 6, F.when(_k() % 4 == 0, F.col("c")), horizon, F.col("slope"), growth),
        "competitive": G.competitive_layer(_k() % 6, _k() % 5 + 1, F.element_at(F.array(F.lit("local_db"), F.lit("external_fetch"), F.lit("other")), (1 + _k() % 3).cast("int")), G.competitive_completeness(_k() % 4, _k() * 3, _k() % 4 + 1)),
        "kpi": G.kpi_layer(_k() % 6, F.lit(5), (_k() % 4) / 3, _k() % 5),
        "cohort": G.cohort_layer(_k() % 3),
        "segmentation": G.cohort_layer(_k() % 3, 0.4),
    }
    rows = F.array(*(F.struct(F.lit(n).alias("layer"), c.alias("x")) for n, c in parts.items()))
    return x.select("entity", "metric", F.inline(rows)).select("entity", "metric", "layer", "x.*")


_LSAT = "ln(greatest({0}, 1)::DOUBLE) / ln(greatest({0}, 1)::DOUBLE + 1)"
register(
    "integrity_layers",
    on_series(_layer_scores),
    with_series(_FIT + f"""
, f AS (SELECT *, k % 9 + 3 AS pts, least(1, r2 * 6) AS fit, sign(slope) * (k % 3 - 1) < 0 AND r2 * 6 < 0.5 AS ag, CASE WHEN k % 4 = 0 THEN c ELSE {_LSAT.format("(k % 9 + 3)")} * least(1, r2 * 6) / (1 + ln(1 + CASE WHEN k % 2 = 0 THEN k % 7 ELSE 3 END)) END AS own FROM fr WHERE metric IN ('arpu', 'order_count'))
, q AS (SELECT *, CASE WHEN k % 4 > 0 THEN ln(1.0 + k % 4) / ln(2.0 + k % 4) WHEN k > 0 THEN sqrt(least(1, ln(1.0 + 3 * k) / ln(25.0 + 3 * k)) * {_LSAT.format("(k % 4 + 2)")}) ELSE 0 END AS cc FROM f)
, l AS (
  SELECT entity, metric, 'forecast' AS layer, CASE WHEN st = 'failed' OR st = 'insufficient_data' OR pts < 6 THEN 0 WHEN fit < 0.10 THEN fit ELSE own END AS score, CASE WHEN st = 'failed' THEN 'block' WHEN st = 'insufficient_data' OR pts < 6 THEN 'degrade' WHEN fit < 0.10 OR ag THEN 'isolate' WHEN fit < 0.30 THEN 'degrade' ELSE 'pass' END AS gate,
    CASE WHEN st = 'failed' THEN 'failed' WHEN st = 'insufficient_data' OR pts < 6 THEN 'insufficient_data' WHEN fit < 0.10 THEN 'isolated_low_r2' WHEN ag THEN 'isolated_direction_conflict' WHEN fit < 0.30 THEN 'degraded_low_r2' ELSE 'success' END AS status FROM q
  UNION ALL SELECT entity, metric, 'competitive', CASE WHEN k % 6 < 2 OR k % 5 + 1 < 2 THEN 0 ELSE sqrt({_LSAT.format("(k % 6)")} * {_LSAT.format("(k % 5 + 1)")}) * CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.5 END * cc END, CASE WHEN k % 6 < 2 OR k % 5 + 1 < 2 THEN 'degrade' ELSE 'pass' END, CASE WHEN k % 6 < 2 OR k % 5 + 1 < 2 THEN 'insufficient_data' ELSE 'success' END FROM q
  UNION ALL SELECT entity, metric, 'kpi', (k % 6) / 5.0 * ((k % 4) / 3.0 + 0.7 * (1 - (k % 4) / 3.0)) * least((k % 5) / 3.0, 1), 'pass', 'success' FROM q
  UNION ALL SELECT entity, metric, n, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN m ELSE 1 END, CASE WHEN k % 3 = 0 THEN 'degrade' ELSE 'pass' END, CASE WHEN k % 3 = 0 THEN 'insufficient_data' ELSE 'success' END FROM q CROSS JOIN (VALUES ('cohort', 0.3), ('segmentation', 0.4)) v(n, m))
SELECT entity, metric, layer, round(least(1, greatest(0, score)), 6)::DOUBLE AS score, gate, status FROM l"""),
)


def _complete(s: DataFrame) -> DataFrame:
    """Entities lack a required metric, optional ones, or none, by their number."""
    lacking = F.element_at(F.array(F.lit("none"), F.lit("arpu"), F.lit("recurring_revenue"), F.lit("order_count")), (1 + _k() % 4).cast("int"))
    have = s.where(F.col("metric") != lacking).groupBy("entity").agg(F.collect_set("metric").alias("h"))
    status, score = G.completeness(F.col("h"), ("recurring_revenue", "active_customer_count"), ("arpu", "order_count", "ltv"))
    return have.select("entity", status.alias("status"), score.alias("score"))


_LACKING = "CASE CAST(substr(entity, 8) AS INT) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'arpu' WHEN 2 THEN 'recurring_revenue' ELSE 'order_count' END"
register(
    "kpi_completeness",
    on_series(_complete),
    with_series(f"""
, h AS (SELECT entity, list(DISTINCT metric) AS h FROM series WHERE metric <> {_LACKING} GROUP BY entity)
, c AS (SELECT entity, NOT list_contains(h, 'recurring_revenue') OR NOT list_contains(h, 'active_customer_count') AS bad, list_contains(h, 'arpu')::INT + list_contains(h, 'order_count')::INT + list_contains(h, 'ltv')::INT AS o FROM h)
SELECT entity, CASE WHEN bad THEN 'failed' WHEN o < 3 THEN 'partial' ELSE 'success' END AS status, round(CASE WHEN bad THEN 0 ELSE 0.6 + 0.4 * o / 3.0 END, 6)::DOUBLE AS score FROM c"""),
)


def _ready(s: DataFrame) -> DataFrame:
    """The order count stands for lost customers, arpu for conversions, for as many months as the entity's number says."""
    name = F.when(F.col("metric") == "order_count", "lost_customers").when(F.col("metric") == "arpu", "signup_rate").otherwise(F.col("metric"))
    return G.readiness(s.where((F.col("metric") == "recurring_revenue") | (F.col("seq") < _k() % 5)).withColumn("metric", name))


register(
    "kpi_readiness",
    on_series(_ready),
    with_series("""
, c AS (SELECT entity, metric, count(value) AS n FROM series WHERE metric = 'recurring_revenue' OR seq < CAST(substr(entity, 8) AS INT) % 5 GROUP BY ALL)
, h AS (SELECT entity, bool_or(metric = 'recurring_revenue' AND n >= 2) AS r, bool_or(metric = 'order_count' AND n >= 2) AS l, bool_or(metric = 'arpu' AND n >= 2) AS s FROM c GROUP BY entity)
SELECT entity, r AS has_revenue, l AS has_churn, s AS has_conversion, r AND l AND s AS ready FROM h"""),
)
register(
    "kpi_coverage",
    on_series(lambda s: G.coverage(s.where(F.col("seq") + F.length("metric") < _k() * 4), ("recurring_revenue", "arpu", "order_count", "ltv", "cac"))),
    with_series("""
, h AS (SELECT entity, count(DISTINCT CASE WHEN metric IN ('recurring_revenue', 'arpu', 'order_count') THEN metric END) AS n FROM series WHERE seq + length(metric) < CAST(substr(entity, 8) AS INT) * 4 GROUP BY entity)
SELECT entity, round(n / 5.0, 6)::DOUBLE AS coverage, n / 5.0 >= 0.5 AS sufficient FROM h"""),
)
register(
    "pipeline_status",
    on_series(lambda s: G.pipeline_status(s.groupBy("entity", F.col("metric").alias("node")).agg(F.count(F.lit(1)).alias("n")).select(
        "entity", "node", (F.col("node") == "recurring_revenue").alias("required"), F.when((F.col("n") % 7 == 0) & (F.col("node") == "arpu"), "failed").otherwise("success").alias("status")))),
    with_series("""
, n AS (SELECT entity, metric, count(*) AS n FROM series GROUP BY ALL)
SELECT entity, CASE WHEN max(CASE WHEN metric = 'arpu' AND n % 7 = 0 THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'success' END AS status FROM n GROUP BY entity"""),
)
register(
    "kpi_insight_rows",
    on_series(lambda s: G.insight_rows(s.where(F.col("seq") < 1 + _k() % 20))),
    with_series(f"""
, g AS (SELECT *, lag(value) OVER ({_S}) AS p FROM series WHERE seq < 1 + CAST(substr(entity, 8) AS INT) % 20)
, a AS (SELECT entity, metric, count(*) AS n, arg_max(value, seq) AS latest, arg_max_null(p, seq) AS previous, avg(value) AS m, stddev_pop(value) AS sd, regr_slope(value, seq) AS b FROM g GROUP BY entity, metric)
, i AS (SELECT *, CASE WHEN previous <> 0 THEN (latest - previous) / abs(previous) END AS ch, CASE WHEN n >= 2 THEN CASE WHEN abs(m) < 1e-12 THEN 0 ELSE sd / abs(m) END END AS cv FROM a)
SELECT entity, metric, n, round(latest, 6) AS latest, round(previous, 6) AS previous, round(ch, 6) AS change, CASE WHEN ch IS NULL THEN 'unknown' WHEN ch > 0.05 THEN 'growing' WHEN ch < -0.05 THEN 'declining' ELSE 'stable' END AS status,
  round(CASE WHEN n >= 3 THEN b / CASE WHEN abs(m) < 1e-12 THEN 1 ELSE abs(m) END END, 6) AS trend, round(cv, 6) AS cv, CASE WHEN cv IS NULL THEN 'unknown' WHEN cv > 0.30 THEN 'high' WHEN cv > 0.10 THEN 'medium' ELSE 'low' END AS volatility,
  round(greatest(0.1, least(1, n / 12.0) - least(0.3, 0.3 * coalesce(cv, 0))), 6)::DOUBLE AS confidence FROM i"""),
)


def _blended(s: DataFrame) -> DataFrame:
    x = G.series_confidence(s).select("entity", "metric", "confidence", "outliers").join(_fits(s), ["entity", "metric"])
    return x.select("entity", "metric", G.engine_confidence(F.col("confidence"), F.when(F.col("status") != "failed", F.col("c")), F.col("status"), F.col("regime"), F.col("outliers") > 0, (_k() % 4) / 20).alias("confidence"))


register(
    "engine_confidence_blend",
    on_series(_blended),
    with_series(_CONF + _FIT + """
, b AS (SELECT entity, metric, k, st, regime, CASE WHEN depth = 0 THEN 0 ELSE exp((ln(greatest(depth, 1e-9)) + ln(greatest(vol, 1e-9)) + ln(greatest(ano, 1e-9))) / 4) END AS x, CASE WHEN st <> 'failed' THEN c END AS c, outliers,
    CASE regime WHEN 'low' THEN 0.35 WHEN 'normal' THEN 0.35 WHEN 'high' THEN 0.20 WHEN 'insufficient_history' THEN 0.15 ELSE 0.25 END AS w FROM sc JOIN fr USING (entity, metric))
, m AS (SELECT *, CASE WHEN c IS NULL THEN 0.85 * x ELSE (1 - w) * x + w * c END - CASE WHEN outliers > 0 THEN 0.08 ELSE 0 END - CASE WHEN (k % 4) / 20.0 >= 0.1 THEN 0.12 ELSE 0 END AS y FROM b)
SELECT entity, metric, round(least(0.99, greatest(0, least(y, CASE WHEN st = 'insufficient_data' THEN 0.45 ELSE 9 END, CASE WHEN c IS NOT NULL AND regime = 'high' THEN 0.80 ELSE 9 END))), 6)::DOUBLE AS confidence FROM m"""),
)


def _parts(s: DataFrame) -> DataFrame:
    """The three parts of a composite confidence, each missing for some entities."""
    part = lambda i, x: F.when(_k() % (i + 2) != 0, x / 100)
    return s.select("entity").distinct().select("entity", G.composite_confidence(part(0, _k() * 3), part(1, 90 - _k()), part(2, 40 + _k())).alias("confidence"))


register(
    "composite_confidence_parts",
    on_series(_parts),
    with_series("""
, e AS (SELECT DISTINCT entity, CAST(substr(entity, 8) AS INT) AS k FROM series)
, p AS (SELECT entity, CASE WHEN k % 2 <> 0 THEN 3 * k / 100.0 END AS a, CASE WHEN k % 3 <> 0 THEN (90 - k) / 100.0 END AS b, CASE WHEN k % 4 <> 0 THEN (40 + k) / 100.0 END AS c FROM e)
SELECT entity, round(coalesce((coalesce(a * 0.40, 0) + coalesce(b * 0.35, 0) + coalesce(c * 0.25, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.40 END + CASE WHEN b IS NULL THEN 0 ELSE 0.35 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END, 0), 0), 6)::DOUBLE AS confidence FROM p"""),
)
