"""Queries of the statistical series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.operators import models as M
from tallygrove.operators import series as S
from tallygrove.operators import windows as W
from tallygrove.plans.registry import on_facts, on_series, register, with_facts, with_recursive_series, with_series

_S = "PARTITION BY entity, metric ORDER BY seq"
_P = "PARTITION BY entity, metric"

_OLS = """
, fit0 AS (
  SELECT entity, metric, count(value) AS n, avg(value) AS mean, regr_slope(value, seq) AS s, regr_intercept(value, seq) AS i,
    var_pop(value) AS vy, var_pop(seq) AS vx, arg_max(value, seq) AS last, max(seq) AS last_seq FROM series GROUP BY ALL
), fit1 AS (SELECT *, CASE WHEN vx * n < 1e-9 THEN 0 ELSE coalesce(s, 0) END AS slope FROM fit0
), fit AS (
  SELECT *, coalesce(i, mean) AS intercept, CASE WHEN vy < 1e-9 THEN 0 ELSE greatest(0, 1 - (vy - slope * slope * vx) / greatest(vy, 1e-9)) END AS r_squared,
    CASE WHEN n > 2 THEN sqrt(greatest(vy - slope * slope * vx, 0) * n / greatest(n - 2, 1)) ELSE 0 END AS residual_std FROM fit1
)"""
_LABEL = """CASE WHEN {0} > 0.05 THEN 'strong_uptrend' WHEN {0} > 0.01 THEN 'uptrend' WHEN {0} < -0.05 THEN 'strong_downtrend' WHEN {0} < -0.01 THEN 'downtrend' ELSE 'stable' END"""
_SHARE = "(CASE WHEN mean = 0 THEN slope ELSE slope / abs(mean) END)"

register(
    "ols_trend",
    on_series(lambda s: S.ols(s).select(
        "entity", "metric", "n", "slope", "intercept", "r_squared", "residual_std",
        S.trend_label(F.col("slope"), F.col("mean")).alias("label"), S.trend_label_gated(F.col("slope"), F.col("mean"), F.col("r_squared")).alias("gated_label"))),
    with_series(_OLS + f"""
SELECT entity, metric, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r_squared, 6) AS r_squared, round(residual_std, 6) AS residual_std,
  {_LABEL.format(_SHARE)} AS label, CASE WHEN r_squared < 0.3 THEN 'inconclusive' ELSE {_LABEL.format(_SHARE)} END AS gated_label FROM fit"""),
)
register(
    "linear_forecast_3",
    on_series(S.linear_forecast),
    with_series(_OLS + """
SELECT entity, metric, step, round(last + step * slope, 6) AS forecast,
  round((last - (slope * last_seq + intercept)) / greatest(abs(slope * last_seq + intercept), 1e-9), 6) AS deviation, round(slope, 6) AS slope, round(r_squared, 6) AS r_squared
FROM fit, (VALUES (1), (2), (3)) t(step)"""),
)
register(
    "line_forecast_3",
    on_series(S.line_forecast),
    with_series(_OLS + """
SELECT entity, metric, step, round(intercept + slope * (last_seq + step), 6) AS forecast,
  round(least(1, greatest(0, 0.7 * r_squared + 0.3 * least(n / 12.0, 1))), 6) AS confidence FROM fit, (VALUES (1), (2), (3)) t(step)"""),
)
register(
    "drift_forecast_3",
    on_series(S.drift_forecast),
    with_series(f"""
, d AS (SELECT *, value - lag(value) OVER ({_S}) AS d FROM series)
, e AS (SELECT entity, metric, arg_max(value, seq) AS last, coalesce(avg(d), 0) AS drift, count(value) AS n FROM d GROUP BY ALL)
SELECT entity, metric, step, round(last + step * drift, 6) AS forecast, round(least(0.4, 0.1 * n), 6)::DOUBLE AS confidence FROM e, (VALUES (1), (2), (3)) t(step)"""),
)
register(
    "rolling_forecast_3",
    on_series(S.rolling_forecast),
    with_series(f"""
, r AS (SELECT entity, metric, seq, avg(value) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM series)
, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
SELECT entity, metric, step, round(f, 6) AS forecast FROM l, (VALUES (1), (2), (3)) t(step)"""),
)
register(
    "tiered_forecast",
    on_series(S.tiered_forecast),
    with_series(_OLS + f"""
, sd AS (SELECT entity, metric, stddev_pop(value) AS sd FROM series GROUP BY ALL)
, ro AS (SELECT entity, metric, avg(value) AS roll FROM (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) <= 3) GROUP BY ALL)
, j AS (SELECT *, sd / greatest(abs(mean), 1e-9) AS cv FROM fit JOIN sd USING (entity, metric) JOIN ro USING (entity, metric))
SELECT entity, metric, n, CASE WHEN n < 3 THEN 'insufficient' WHEN n < 6 THEN 'minimal' WHEN n < 12 THEN 'standard' ELSE 'robust' END AS tier,
  CASE WHEN n < 3 THEN 'none' WHEN n < 6 THEN 'rolling_average' ELSE 'ols_regression' END AS model,
  round(CASE WHEN n < 3 THEN 0 ELSE greatest(0, least(
      CASE WHEN n >= 6 AND r_squared < 0.1 THEN least(0.15, CASE WHEN n < 6 THEN 0.4 WHEN n < 12 THEN 0.8 ELSE 1 END) WHEN n < 6 THEN 0.4 WHEN n < 12 THEN 0.8 ELSE 1 END,
      CASE WHEN n <= 1 THEN 0 ELSE least(1, ln(n::DOUBLE) / ln(12.0::DOUBLE)) END * CASE WHEN n >= 6 THEN r_squared ELSE 1 END * greatest(0.3, 1 - least(0.7, cv / 2)))) END, 6) AS confidence,
  CASE WHEN n < 6 OR r_squared < 0.3 THEN 'inconclusive' ELSE {_LABEL.format(_SHARE)} END AS trend,
  round(CASE WHEN n < 3 THEN NULL WHEN n < 6 THEN roll ELSE last + slope END, 6) AS next_value FROM j"""),
)

_RESID = f"""
, res AS (SELECT *, value - (avg(value) OVER w + coalesce(regr_slope(value, seq) OVER w, 0) * (seq - avg(seq) OVER w)) AS residual FROM series WINDOW w AS ({_P}))"""

register(
    "linear_detrend",
    on_series(lambda s: S.detrended(s).select("entity", "metric", "seq", "residual")),
    with_series(_RESID + "\nSELECT entity, metric, seq, round(residual, 6) + 0.0 AS residual FROM res"),
)
register(
    "durbin_watson",
    on_series(lambda s: S.durbin_watson(S.detrended(s))),
    with_series(_RESID + f"""
, d AS (SELECT *, residual - lag(residual) OVER ({_S}) AS d FROM res)
SELECT entity, metric, round(CASE WHEN sum(residual * residual) > 1e-12 THEN sum(d * d) / sum(residual * residual) END, 6) AS durbin_watson FROM d GROUP BY ALL"""),
)
register(
    "autocorrelation",
    on_series(lambda s: S.autocorrelation(s, [1, 3, 6, 12])),
    with_series(f"""
, c AS (SELECT *, value - avg(value) OVER ({_P}) AS c FROM series)
, p AS (SELECT entity, metric, seq, c, k AS lag, lag(c, k) OVER (PARTITION BY entity, metric, k ORDER BY seq) AS b FROM c, (VALUES (1), (3), (6), (12)) t(k))
SELECT entity, metric, count(*) AS n, lag, round(CASE WHEN sum(c * c) <= 1e-9 THEN 0 ELSE coalesce(sum(c * b), 0) / sum(c * c) END, 6) AS acf FROM p GROUP BY entity, metric, lag"""),
)
register("ljung_box", on_series(lambda s: S.ljung_box(S.detrended(s))))

_FLAGS = f"""
, q AS (SELECT *, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3, quantile_cont(value, 0.5) OVER w AS med,
    avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM series WINDOW w AS ({_P}))
, fl AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER ({_P}) AS mad FROM q)
, flags AS (
  SELECT *, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_iqr, abs(0.6745 * (value - med) / greatest(mad, 1e-9)) >= 3.5 AS is_mad,
    n >= 5 AND abs((value - m) / greatest(sd, 1e-9)) >= 2.5 AS is_z FROM fl)"""
register(
    "iqr_bounds",
    on_series(S.iqr_bounds),
    with_series("""
, q AS (SELECT entity, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM series GROUP BY ALL HAVING count(value) >= 2)
SELECT entity, metric, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM q"""),
)
register(
    "anomaly_flags",
    on_series(lambda s: S.anomaly_flags(s).select("entity", "metric", "seq", "is_iqr", "is_mad", "is_z")),
    with_series(_FLAGS + "\nSELECT entity, metric, seq, is_iqr, is_mad, is_z FROM flags"),
)
register(
    "zscore_outlier_count",
    on_series(lambda s: S.anomaly_flags(s).groupBy("entity", "metric").agg(F.count(F.when(F.col("is_z"), 1)).alias("outliers"), F.count(F.when(F.col("is_iqr"), 1)).alias("iqr_outliers"))),
    with_series(_FLAGS + "\nSELECT entity, metric, count(CASE WHEN is_z THEN 1 END) AS outliers, count(CASE WHEN is_iqr THEN 1 END) AS iqr_outliers FROM flags GROUP BY ALL"),
)
register(
    "seasonal_residual_anomalies",
    on_series(lambda s: S.phase_residual_flags(s, 12).where("is_seasonal").select("entity", "metric", "seq")),
    with_series(f"""
, r AS (SELECT *, value - avg(value) OVER (PARTITION BY entity, metric, seq % 12) AS r FROM series)
SELECT entity, metric, seq FROM r QUALIFY abs(r / greatest(stddev_pop(r) OVER ({_P}), 1e-9)) >= 2.5"""),
)
# Sums that start again after each hit are followed value by value.
_STEPS = """
, sx AS MATERIALIZED (SELECT entity, metric, seq, value - avg(value) OVER w AS d, 4 * stddev_pop(value) OVER w AS lim, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY entity, metric))"""
register(
    "cusum_shifts",
    on_series(lambda s: S.cusum_shifts(s).withColumn("shifts", F.array_join("shifts", ","))),
    with_recursive_series(_STEPS + """
, rc AS (
  SELECT entity, metric, seq, 0::DOUBLE AS s, ''::VARCHAR AS hits FROM sx WHERE seq = 0
  UNION ALL
  SELECT x.entity, x.metric, x.seq, CASE WHEN abs(r.s + x.d) >= lim THEN 0 ELSE r.s + x.d END, CASE WHEN abs(r.s + x.d) >= lim THEN hits || CASE WHEN hits = '' THEN '' ELSE ',' END || x.seq ELSE hits END
  FROM rc r JOIN sx x ON x.entity = r.entity AND x.metric = r.metric AND x.seq = r.seq + 1)
SELECT entity, metric, CASE WHEN any_value(n) >= 8 AND any_value(lim) > 4e-9 THEN arg_max(hits, seq) ELSE '' END AS shifts FROM rc JOIN sx USING (entity, metric, seq) GROUP BY entity, metric"""),
)
register(
    "cusum_changepoints",
    on_series(lambda s: S.two_sided_cusum(s).withColumn("changepoints", F.array_join("changepoints", ","))),
    with_recursive_series(_STEPS + """
, rc AS (
  SELECT entity, metric, seq, 0::DOUBLE AS up, 0::DOUBLE AS down, ''::VARCHAR AS hits, -9::BIGINT AS last, 0::BIGINT AS c FROM sx WHERE seq = 0
  UNION ALL
  SELECT entity, metric, seq, CASE WHEN h THEN 0 ELSE u END, CASE WHEN h THEN 0 ELSE w END, CASE WHEN k THEN hits || CASE WHEN hits = '' THEN '' ELSE ',' END || seq ELSE hits END, CASE WHEN k OR (h AND seq - last >= 4) THEN seq ELSE last END, c + k::INT
  FROM (SELECT *, h AND seq - last >= 4 AND c < 5 AS k FROM (SELECT *, u > lim OR w < -lim AS h FROM (
    SELECT x.entity, x.metric, x.seq, greatest(0, r.up + x.d) AS u, least(0, r.down + x.d) AS w, lim, hits, last, c FROM rc r JOIN sx x ON x.entity = r.entity AND x.metric = r.metric AND x.seq = r.seq + 1))))
SELECT entity, metric, CASE WHEN any_value(n) >= 8 AND any_value(lim) > 4e-9 THEN arg_max(hits, seq) ELSE '' END AS changepoints FROM rc JOIN sx USING (entity, metric, seq) GROUP BY entity, metric"""),
)
register("binary_segmentation", on_series(S.binary_segmentation))
register("combined_changepoints", on_series(S.changepoints))
register("ensemble_anomalies", on_series(lambda s: S.ensemble_anomalies(s, period=12)))

_VR = """
, ph AS (SELECT entity, metric, seq % 12 AS ph, var_pop(value) AS v FROM series GROUP BY ALL)
, av AS (SELECT entity, metric, avg(v) AS v FROM ph GROUP BY ALL)
, tot AS (SELECT entity, metric, var_pop(value) AS t FROM series GROUP BY ALL)"""
register(
    "variance_ratio",
    on_series(lambda s: S.variance_ratio(s, 12)),
    with_series(_VR + "\nSELECT entity, metric, 12 AS period, round(CASE WHEN t > 1e-9 THEN v / t ELSE 1 END, 6) AS variance_ratio FROM av JOIN tot USING (entity, metric)"),
)
register(
    "month_seasonality",
    on_series(lambda s: S.month_seasonality(s.where("metric = 'recurring_revenue'"))),
    with_series("""
, s1 AS (SELECT * FROM series WHERE metric = 'recurring_revenue')
, mm AS (SELECT entity, metric, month(ts) AS m, avg(value) AS a FROM s1 GROUP BY ALL)
, b AS (SELECT entity, metric, var_pop(a) AS b, count(*) AS months, arg_max(m, a) AS peak_month, arg_min(m, a) AS trough_month FROM mm GROUP BY ALL)
, t AS (SELECT entity, metric, var_pop(value) AS t FROM s1 GROUP BY ALL)
SELECT entity, metric, months, round(CASE WHEN t > 1e-9 THEN b / t ELSE 0 END, 6) AS ratio, (CASE WHEN t > 1e-9 THEN b / t ELSE 0 END) >= 0.15 AND months >= 6 AS seasonal, peak_month, trough_month
FROM b JOIN t USING (entity, metric)"""),
)
register(
    "dft_peak",
    on_series(S.spectral_peak),
    with_series(_RESID + f"""
, rn AS (SELECT *, count(*) OVER ({_P}) AS n FROM res)
, wv AS (SELECT entity, metric, n, k, sum(residual * cos(2 * pi() * k * seq / n)) AS c, sum(residual * sin(2 * pi() * k * seq / n)) AS s
  FROM rn, range(1, 400) t(k) WHERE n >= 4 AND k <= n // 2 GROUP BY ALL)
, pw AS (SELECT *, c * c + s * s AS p FROM wv)
SELECT entity, metric, arg_max(k, p) AS k, round(any_value(n) / arg_max(k, p)::DOUBLE, 6) AS period, round(CASE WHEN sum(p) > 1e-9 THEN max(p) / sum(p) ELSE 0 END, 6) AS power_share
FROM pw GROUP BY entity, metric"""),
)
register("seasonality_tests", on_series(S.detect_seasonality))
register(
    "structural_break",
    on_series(S.structural_break),
    with_series(_RESID + f"""
, c AS (SELECT *, row_number() OVER ({_S}) - 1 AS ln, count(*) OVER ({_P}) AS n, sum(residual) OVER b AS l, sum(residual) OVER ({_P}) AS t, sum(value) OVER b AS rl, sum(value) OVER ({_P}) AS rt, stddev_pop(residual) OVER ({_P}) AS sd
    FROM res WINDOW b AS ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, k AS (SELECT *, abs((t - l) / (n - ln) - l / ln) / greatest(sd, 1e-9) AS score, abs((rt - rl) / (n - ln) - rl / ln) AS d FROM c WHERE ln >= 6 AND n - ln >= 6)
SELECT entity, metric, seq AS break_at, round(score, 6) AS score, round(d, 6) AS shift, score >= 0.95 AND d >= 5 AS is_break FROM k QUALIFY row_number() OVER ({_P} ORDER BY round(score, 9) DESC, seq) = 1"""),
)
register("holt_linear_grid", on_series(S.holt_linear))
register("holt_winters_grid", on_series(S.holt_winters))

_TAIL = """
, bk AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) AS back FROM series)
, pr AS (SELECT a.entity, a.metric AS a, b.metric AS b, a.back, a.value AS x, b.value AS y FROM bk a JOIN bk b ON a.entity = b.entity AND a.back = b.back AND a.metric < b.metric)"""
register(
    "pearson_pairs",
    on_series(S.pearson_pairs),
    with_series(_TAIL + """
SELECT entity, a, b, count(*) AS n, round(CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS r
FROM pr GROUP BY entity, a, b HAVING count(*) >= 5"""),
)
register(
    "spearman_pairs",
    on_series(S.spearman_pairs),
    with_series(_TAIL + """
, rk AS (SELECT *, rank() OVER (PARTITION BY entity, a, b ORDER BY x) + (count(*) OVER (PARTITION BY entity, a, b, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY entity, a, b ORDER BY y) + (count(*) OVER (PARTITION BY entity, a, b, y) - 1) / 2.0 AS ry FROM pr)
SELECT entity, a, b, count(*) AS n, round(CASE WHEN stddev_pop(rx) > 1e-9 AND stddev_pop(ry) > 1e-9 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 6) AS rho
FROM rk GROUP BY entity, a, b HAVING count(*) >= 5"""),
)
register("significant_correlations", on_series(lambda s: S.significant_pairs(S.spearman_pairs(s), "rho")))
register(
    "lead_lag_ccf",
    on_series(S.cross_correlation),
    with_series(_TAIL + """
, sh AS (SELECT p.entity, p.a, p.b, l.lag, p.x, q.y FROM pr p, range(-6, 7) l(lag) JOIN pr q ON q.entity = p.entity AND q.a = p.a AND q.b = p.b AND q.back = p.back - l.lag)
, pe AS (SELECT entity, a, b, lag, count(*) AS n, CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r FROM sh GROUP BY ALL HAVING count(*) >= 5)
SELECT entity, a, b, lag, n, round(r, 6) AS r, abs(r) >= 1.96 / sqrt(n::DOUBLE) AS significant FROM pe WHERE r IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY entity, a, b ORDER BY round(abs(r), 9) DESC, lag) = 1"""),
)
register("lead_lag_roles", on_series(lambda s: S.lead_lag_roles(S.cross_correlation(s))))
register(
    "variance_decomposition",
    on_series(S.variance_decomposition),
    with_series("""
, v AS (SELECT entity, metric, var_pop(value) AS variance FROM series GROUP BY ALL)
SELECT entity, metric, round(variance, 6) AS variance, round(CASE WHEN sum(variance) OVER (PARTITION BY entity) > 1e-9 THEN variance / sum(variance) OVER (PARTITION BY entity) ELSE 0 END, 6) AS share FROM v"""),
)
register("granger_pairs", on_series(S.granger))


def _lifetimes(f):
    """Days from a customer's first to last order; observed if no order came in the table's last 90 days."""
    per = f.groupBy("region", "customer").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    end = f.agg(F.max("ts").alias("end"))
    return per.crossJoin(F.broadcast(end)).select(  # one row
        "region", F.floor(F.datediff("b", "a") / 90).alias("duration"), (F.datediff("end", "b") > 90).alias("observed"))


_LIFE = """
, per AS (SELECT region, customer, min(ts) AS a, max(ts) AS b FROM facts GROUP BY ALL)
, life AS (SELECT region, date_diff('day', a::DATE, b::DATE) // 90 AS duration, date_diff('day', b::DATE, (SELECT max(ts)::DATE FROM facts)) > 90 AS observed FROM per)
, ev AS (SELECT region, duration, count(*) AS c, sum(observed::INT) AS events FROM life GROUP BY ALL)
, ri AS (SELECT *, sum(c) OVER (PARTITION BY region) - coalesce(sum(c) OVER (PARTITION BY region ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk FROM ev)
, su AS (
  SELECT *, CASE WHEN max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(ln(CASE WHEN events < at_risk THEN 1 - events / at_risk::DOUBLE END)) OVER w) END AS survival,
    coalesce(sum(events / nullif(at_risk * (at_risk - events), 0)::DOUBLE) OVER w, 0) AS v
  FROM ri WINDOW w AS (PARTITION BY region ORDER BY duration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, km AS (SELECT * FROM su WHERE events > 0)"""
register(
    "kaplan_meier",
    on_facts(lambda f: S.kaplan_meier(_lifetimes(f), ["region"])),
    with_facts(_LIFE + """
SELECT region, duration::BIGINT AS duration, at_risk::BIGINT AS at_risk, events::BIGINT AS events, round(survival, 6) AS survival,
  round(least(1, greatest(0, survival - 1.96 * survival * sqrt(v))), 6) AS lower, round(least(1, greatest(0, survival + 1.96 * survival * sqrt(v))), 6) AS upper FROM km"""),
)
register(
    "median_survival",
    on_facts(lambda f: S.median_survival(S.kaplan_meier(_lifetimes(f), ["region"]), ["region"])),
    with_facts(_LIFE + "\nSELECT region, min(CASE WHEN survival <= 0.5 THEN duration END)::BIGINT AS median FROM km GROUP BY region"),
)
register(
    "restricted_mean_survival",
    on_facts(lambda f: S.restricted_mean(_lifetimes(f), ["region"])),
    with_facts(_LIFE + """
, ar AS (SELECT region, (duration - coalesce(lag(duration) OVER w, 0)) * (survival + coalesce(lag(survival) OVER w, 1)) / 2 AS a FROM su WINDOW w AS (PARTITION BY region ORDER BY duration))
SELECT region, round(sum(a), 6)::DOUBLE AS mean_survival FROM ar GROUP BY region"""),
)
register(
    "halves_trend",
    on_series(S.halves_trend),
    with_series(f"""
, h AS (SELECT *, row_number() OVER ({_S}) - 1 >= count(*) OVER ({_P}) // 2 AS late FROM series)
, m AS (SELECT entity, metric, avg(CASE WHEN NOT late THEN value END) AS f, avg(CASE WHEN late THEN value END) AS s FROM h GROUP BY ALL)
, c AS (SELECT *, (s - f) / greatest(abs(f), 1e-9) AS ch FROM m)
SELECT entity, metric, round(f, 6) AS first_half, round(s, 6) AS second_half, round(ch, 6) AS change, CASE WHEN ch > 0.05 THEN 'growing' WHEN ch < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM c"""),
)
register(
    "volatility_label",
    on_series(S.volatility_label),
    with_series("""
, v AS (SELECT entity, metric, stddev_pop(value) / greatest(abs(avg(value)), 1e-9) AS cv FROM series GROUP BY ALL)
SELECT entity, metric, round(cv, 6) AS cv, CASE WHEN cv < 0.1 THEN 'low' WHEN cv < 0.3 THEN 'moderate' ELSE 'high' END AS volatility FROM v"""),
)
_CHANGES = f"""
, pb AS (SELECT *, lag(value) OVER ({_S}) AS b FROM series)
, ch AS (SELECT entity, metric, seq, value, CASE WHEN abs(b) >= 1e-9 THEN (value - b) / abs(b) END AS g FROM pb)"""
register(
    "implied_churn",
    on_series(S.implied_churn),
    with_series(_CHANGES + """
, a AS (SELECT entity, metric, count(value) AS n, count(g) AS changes, count(CASE WHEN g < 0 THEN 1 END) AS falls, avg(CASE WHEN g < 0 THEN -g END) AS f FROM ch GROUP BY ALL)
SELECT entity, metric, changes, falls, round(CASE WHEN n >= 4 AND falls >= 0.4 * changes AND least(0.5, 0.7 * f) >= 0.01 THEN least(0.5, 0.7 * f) END, 6) AS implied_churn FROM a"""),
)
register(
    "growth_efficiency",
    on_series(S.growth_efficiency),
    with_series(_CHANGES + f"""
, gg AS (SELECT *, row_number() OVER ({_S}) - 1 >= count(*) OVER ({_P}) // 2 AS late FROM ch WHERE g IS NOT NULL)
, a AS (SELECT entity, metric, count(*) AS periods, avg(g) AS velocity, CASE WHEN count(*) >= 2 THEN stddev_pop(g) / greatest(abs(avg(g)), 1e-9) ELSE 0 END AS cv,
    coalesce(avg(CASE WHEN late THEN g END) - avg(CASE WHEN NOT late THEN g END), 0) AS acceleration, avg((g < 0)::INT) AS decline_ratio FROM gg GROUP BY ALL)
SELECT entity, metric, periods, round(velocity, 6) AS velocity, round(cv, 6) AS cv, round(acceleration, 6) AS acceleration, round(decline_ratio, 6) AS decline_ratio,
  CASE WHEN decline_ratio > 0.6 AND cv > 0.3 THEN 'high' WHEN decline_ratio > 0.4 OR cv > 0.5 THEN 'moderate' ELSE 'low' END AS burn_risk FROM a"""),
)
register(
    "statistical_context",
    on_series(lambda s: W.rolling(S.anomaly_flags(s), 4).groupBy("entity", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rolling_mean").alias("smoothed_mean"), F.count(F.when(F.col("is_iqr"), 1)).alias("anomalies"))),
    with_series(_FLAGS + f"""
, sm AS (SELECT *, avg(value) OVER ({_S} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rm FROM flags)
SELECT entity, metric, count(*) AS n, round(avg(rm), 6) AS smoothed_mean, count(CASE WHEN is_iqr THEN 1 END) AS anomalies FROM sm GROUP BY ALL"""),
)


# Two models over one frame, chosen per series.
register(
    "forecast_by_model",
    on_series(lambda s: M.forecasts(s.withColumn("model", F.when(F.col("metric") == "recurring_revenue", "line").when(F.col("metric") != "churn_rate", "drift").otherwise("nobody")))),
    with_series("""
, f AS (SELECT entity, metric, count(*) AS n, regr_slope(value, seq) AS b, regr_intercept(value, seq) AS a, max(seq) AS last_seq, max_by(value, seq) AS last, min_by(value, seq) AS first FROM series WHERE value IS NOT NULL GROUP BY ALL)
, m AS (SELECT *, CASE WHEN metric = 'recurring_revenue' THEN 'line' WHEN metric <> 'churn_rate' THEN 'drift' ELSE 'nobody' END AS model FROM f)
, t AS (SELECT *, CASE WHEN model = 'nobody' THEN 'unknown_model' WHEN n < CASE model WHEN 'line' THEN 3 ELSE 2 END THEN 'insufficient_data' ELSE 'ok' END AS status FROM m)
SELECT entity, metric, model, k::INTEGER AS step, round(CASE model WHEN 'line' THEN a + b * (last_seq + k) ELSE last + k * (last - first) / (n - 1) END, 6) AS forecast, status FROM t, range(1, 4) r(k) WHERE status = 'ok'
UNION ALL SELECT entity, metric, model, NULL, NULL, status FROM t WHERE status <> 'ok'"""),
)
