"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.functions import columns as C
from tallygrove.operators import windows as W
from tallygrove.plans.registry import on_facts, on_series, register, with_facts, with_series

_S = "PARTITION BY entity, metric ORDER BY seq"
_P = "PARTITION BY entity, metric"
_GUARD = "greatest(abs({0}), 1e-9)"

register(
    "competition_rank_nations",
    on_facts(lambda f: W.competition_rank(f.groupBy("region", "entity").agg(F.round(F.sum("value"), 2).alias("value")), ["region"]).select(
        "region", "entity", "value", "rank", "n", "percentile", (F.col("field_mean") / 1e6).alias("field_mean"), (F.col("field_median") / 1e6).alias("field_median"))),
    with_facts("""
, v AS (SELECT region, entity, round(sum(value), 2) AS value FROM facts GROUP BY ALL)
SELECT region, entity, round(value, 6) AS value, rank() OVER (PARTITION BY region ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY region) AS n,
  round(CASE WHEN count(*) OVER (PARTITION BY region) <= 1 THEN 100 ELSE
    (count(*) OVER (PARTITION BY region) - rank() OVER (PARTITION BY region ORDER BY value DESC)) / (count(*) OVER (PARTITION BY region) - 1)::DOUBLE * 100 END, 6) AS percentile,
  round(avg(value) OVER (PARTITION BY region) / 1e6, 6) AS field_mean, round(quantile_cont(value, 0.5) OVER (PARTITION BY region) / 1e6, 6) AS field_median
FROM v"""),
)

_LATEST_SQL = """
, latest AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1)
, ranked AS (
  SELECT *, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rnk, count(*) OVER (PARTITION BY metric) AS n FROM latest
)"""

register(
    "overall_competitive_rank",
    on_series(lambda s: W.overall_rank(W.competition_rank(W.latest(s), ["metric"])).select("entity", "mean_percentile", "metrics", "overall_rank", "participants", "overall_percentile", "tier")),
    with_series(_LATEST_SQL + """
, m AS (SELECT entity, avg(CASE WHEN n <= 1 THEN 100 ELSE (n - rnk) / (n - 1)::DOUBLE * 100 END) AS mean_percentile, count(*) AS metrics FROM ranked GROUP BY entity)
, o AS (SELECT *, rank() OVER (ORDER BY round(mean_percentile, 9) DESC) AS overall_rank, count(*) OVER () AS participants FROM m)
, p AS (SELECT *, CASE WHEN participants <= 1 THEN 100 ELSE (participants - overall_rank) / (participants - 1)::DOUBLE * 100 END AS pct FROM o)
SELECT entity, round(mean_percentile, 6) AS mean_percentile, metrics, overall_rank, participants, round(pct, 6) AS overall_percentile,
  CASE WHEN pct >= 75 THEN 'leader' WHEN pct >= 50 THEN 'strong' WHEN pct >= 25 THEN 'average' ELSE 'weak' END AS tier FROM p"""),
)

register(
    "percentile_rank_peers",
    on_series(lambda s: W.share_below(W.latest(s), ["metric"]).select("entity", "metric", "share_below")),
    with_series(_LATEST_SQL + """
SELECT entity, metric, round(CASE WHEN count(*) OVER (PARTITION BY metric) = 1 THEN 50 ELSE
  (rank() OVER (PARTITION BY metric ORDER BY value) - 1) / (count(*) OVER (PARTITION BY metric) - 1)::DOUBLE * 100 END, 6) AS share_below FROM latest"""),
)

register(
    "average_rank_ties",
    on_series(lambda s: W.average_rank(s.where("metric = 'order_count'"), ["entity"]).select("entity", "seq", "midrank")),
    with_series("""
SELECT entity, seq, rank() OVER (PARTITION BY entity ORDER BY value) + (count(*) OVER (PARTITION BY entity, value) - 1) / 2.0 AS midrank
FROM series WHERE metric = 'order_count'"""),
)

register(
    "rolling_mean_median",
    on_series(lambda s: W.rolling(s).select("entity", "metric", "seq", "rolling_mean", "rolling_median")),
    with_series(f"""
SELECT entity, metric, seq, round(avg(value) OVER w, 6) AS rolling_mean, round(quantile_cont(value, 0.5) OVER w, 6) AS rolling_median
FROM series WINDOW w AS ({_S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
)

register(
    "forward_fill",
    on_series(lambda s: W.forward_fill(s.withColumn("value", F.when(F.col("seq") % 3 != 1, F.col("value")))).select("entity", "metric", "seq", "filled")),
    with_series(f"""
SELECT entity, metric, seq, round(last_value(CASE WHEN seq % 3 <> 1 THEN value END IGNORE NULLS) OVER (
  {_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled FROM series"""),
)

register(
    "period_growth",
    on_series(lambda s: W.rolling_growth(W.growth(s)).select("entity", "metric", "seq", "growth", "level_growth", "rolling_growth")),
    with_series(f"""
, g AS (SELECT *, lag(value) OVER ({_S}) AS before FROM series)
, h AS (SELECT *, (value - before) / {_GUARD.format('before')} AS growth FROM g)
SELECT entity, metric, seq, round(growth, 6) AS growth, round(CASE WHEN before <> 0 THEN (value - before) / before END, 6) AS level_growth,
  round(avg(growth) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling_growth FROM h"""),
)

_SIGNALS_SQL = f"""
, lags AS (SELECT *, lag(value, 3) OVER w AS l3, lag(value, 6) OVER w AS l6, lag(value, 12) OVER w AS l12 FROM series WINDOW w AS ({_S}))
, sig AS (
  SELECT *, (value - l3) / greatest(abs(l3), 1e-9) AS short_growth, (value - l6) / greatest(abs(l6), 1e-9) AS mid_growth,
    (value - l12) / greatest(abs(l12), 1e-9) AS long_growth,
    CASE WHEN l12 > 1e-9 AND value > 0 THEN pow(value / l12, 1 / 12.0) - 1 END AS cagr FROM lags
)"""

register(
    "growth_short_mid_long",
    on_series(lambda s: W.growth_signals(s).select("entity", "metric", "seq", "short_growth", "mid_growth", "long_growth", "cagr", "short_mid", "mid_long", "acceleration")),
    with_series(_SIGNALS_SQL + """
SELECT entity, metric, seq, round(short_growth, 6) AS short_growth, round(mid_growth, 6) AS mid_growth, round(long_growth, 6) AS long_growth, round(cagr, 6) AS cagr,
  round(short_growth - mid_growth, 6) AS short_mid, round(mid_growth - long_growth, 6) AS mid_long, round(short_growth - 2 * mid_growth + long_growth, 6) AS acceleration FROM sig"""),
)

register(
    "adaptive_moving_growth",
    on_series(lambda s: s.withColumn("adaptive", W.moving_growth(12, least=3)).select("entity", "metric", "seq", "adaptive")),
    with_series(f"""
, b AS (SELECT *, coalesce(lag(value, 12) OVER w, CASE WHEN row_number() OVER w > 3 THEN first_value(value) OVER w END) AS before FROM series WINDOW w AS ({_S}))
SELECT entity, metric, seq, round((value - before) / {_GUARD.format('before')}, 6) AS adaptive FROM b"""),
)

register(
    "cagr_full_series",
    on_series(lambda s: W.full_cagr(s).select("entity", "metric", "n", "cagr")),
    with_series("""
, e AS (SELECT entity, metric, arg_min(value, seq) AS f, arg_max(value, seq) AS l, count(*) AS n FROM series GROUP BY ALL)
SELECT entity, metric, n, round(CASE WHEN f > 1e-9 AND l > 0 AND n > 1 THEN pow(l / f, 1.0 / (n - 1)) - 1 END, 6) AS cagr FROM e"""),
)

register(
    "mom_qoq_deltas",
    on_series(lambda s: W.deltas(s).select("entity", "metric", "seq", "mom", "qoq")),
    with_series(f"""
SELECT entity, metric, seq, round((value - lag(value) OVER w) / nullif(abs(lag(value) OVER w), 0), 6) AS mom,
  round((value - lag(value, 3) OVER w) / nullif(abs(lag(value, 3) OVER w), 0), 6) AS qoq
FROM series WINDOW w AS ({_S}) QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1"""),
)

register(
    "compounded_growth_restarting",
    on_series(lambda s: W.compounded(W.growth(s).withColumn("g", F.when(F.col("seq") % 12 != 0, F.greatest("growth", F.lit(-0.9)))), "g").select("entity", "metric", "seq", "compounded")),
    with_series(f"""
, g AS (SELECT *, lag(value) OVER ({_S}) AS before FROM series)
, h AS (SELECT *, CASE WHEN seq % 12 <> 0 THEN greatest((value - before) / {_GUARD.format('before')}, -0.9) END AS g FROM g)
, r AS (SELECT *, count(CASE WHEN g IS NULL THEN 1 END) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM h)
SELECT entity, metric, seq, round(CASE WHEN g IS NOT NULL THEN
  exp(sum(ln(1 + g)) OVER (PARTITION BY entity, metric, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 END, 6) AS compounded FROM r"""),
)

_MOMENTUM = f"""
, mo AS (
  SELECT *, row_number() OVER ({_S}) AS place, avg(value) OVER ({_S} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a3,
    avg(value) OVER w8 AS a8, min(value) OVER w8 AS lo, max(value) OVER w8 AS hi
  FROM series WINDOW w8 AS ({_S} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
), mom AS (SELECT *, CASE WHEN place < 8 THEN 0 ELSE (a3 - a8) / greatest(abs(a8), 1e-9) END AS momentum,
    CASE WHEN hi - lo > 1e-9 THEN (value - lo) / (hi - lo) ELSE 0.5 END AS pos FROM mo)"""

register(
    "momentum",
    on_series(lambda s: W.momentum(s).select("entity", "metric", "seq", "momentum")),
    with_series(_MOMENTUM + "\nSELECT entity, metric, seq, round(momentum, 6) AS momentum FROM mom"),
)

register(
    "cycle_state",
    on_series(lambda s: W.cycle_state(s).select("entity", "metric", "momentum", "position", "phase")),
    with_series(_MOMENTUM + """
SELECT entity, metric, round(momentum, 6) AS momentum, round(pos, 6) AS position,
  CASE WHEN momentum >= 0.03 THEN 'expansion' WHEN momentum <= -0.03 THEN 'contraction' WHEN pos >= 0.8 THEN 'peak' WHEN pos <= 0.2 THEN 'trough' ELSE 'neutral' END AS phase
FROM mom QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) = 1"""),
)

_REGIME = f"""
, g AS (SELECT *, (value - lag(value) OVER ({_S})) / greatest(abs(lag(value) OVER ({_S})), 1e-9) AS g,
    row_number() OVER (PARTITION BY entity, metric ORDER BY seq DESC) AS b FROM series)
, st AS (SELECT entity, metric, count(*) AS returns, stddev_pop(CASE WHEN b <= 6 THEN g END) AS recent, stddev_pop(CASE WHEN b > 6 THEN g END) AS earlier, stddev_pop(g) AS every
  FROM g WHERE g IS NOT NULL GROUP BY ALL)
, ba AS (SELECT *, {{0}} AS baseline FROM st)
, ra AS (SELECT *, recent / greatest(baseline, 1e-9) AS ratio FROM ba)
SELECT entity, metric, returns, round(recent, 6) AS recent, round(baseline, 6) AS baseline, round(ratio, 6) AS ratio,
  CASE WHEN returns < 2 THEN 'insufficient_history' WHEN ratio >= 1.25 THEN 'high' WHEN ratio <= 0.8 THEN 'low' ELSE 'normal' END AS regime FROM ra"""

register(
    "volatility_regime",
    on_series(lambda s: W.volatility_regime(s)),
    with_series(_REGIME.format("CASE WHEN returns - 6 >= 2 THEN earlier ELSE every END")),
)
register(
    "volatility_regime_single_baseline",
    on_series(lambda s: W.volatility_regime(s.where("seq < 8"), keep_single=True)),
    with_series(_REGIME.replace("FROM series)", "FROM series WHERE seq < 8)").format("CASE WHEN returns - 6 >= 2 THEN earlier WHEN returns - 6 = 1 THEN recent ELSE every END")),
)

register(
    "lag_matrix",
    on_series(lambda s: W.lag_matrix(s.where("metric = 'recurring_revenue'"), 3).select("entity", "seq", "lag_1", "lag_2", "lag_3")),
    with_series(f"""
SELECT entity, seq, round(lag(value, 1, 0.0) OVER w, 6) AS lag_1, round(lag(value, 2, 0.0) OVER w, 6) AS lag_2, round(lag(value, 3, 0.0) OVER w, 6) AS lag_3
FROM series WHERE metric = 'recurring_revenue' WINDOW w AS ({_S})"""),
)

register(
    "running_max",
    on_series(lambda s: W.running_max(s, "value").select("entity", "metric", "seq", "running_max")),
    with_series(f"SELECT entity, metric, seq, round(max(value) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_max FROM series"),
)

register(
    "level_shift",
    on_series(lambda s: W.level_shift(s).select("entity", "metric", "seq", "shift", "direction")),
    with_series(f"""
, m AS (SELECT entity, metric, seq, avg(value) OVER ({_S} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, avg(value) OVER ({_S} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM series)
SELECT entity, metric, seq, round(a - b, 6) AS shift, CASE WHEN (a - b) / nullif(abs(b), 0) > 0.02 THEN 'up' WHEN (a - b) / nullif(abs(b), 0) < -0.02 THEN 'down' ELSE 'flat' END AS direction FROM m"""),
)

register(
    "minmax_scores",
    on_series(lambda s: W.minmax(W.latest(s), ["metric"], "value", "score").select("entity", "metric", "score")),
    with_series(_LATEST_SQL + """
SELECT entity, metric, round(CASE WHEN max(value) OVER w - min(value) OVER w <= 1e-9 THEN 50 ELSE
  least(100, greatest(0, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 100)) END, 6) AS score FROM latest WINDOW w AS (PARTITION BY metric)"""),
)

register(
    "zscore_clipped",
    on_series(lambda s: s.withColumn("z", C.zscore(F.col("value"), F.avg("value").over(W.whole()), F.stddev_pop("value").over(W.whole()), 2.5)).select("entity", "metric", "seq", "z")),
    with_series(f"""
SELECT entity, metric, seq, round(least(2.5, greatest(-2.5, (value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-9))), 6) AS z
FROM series WINDOW w AS ({_P})"""),
)
