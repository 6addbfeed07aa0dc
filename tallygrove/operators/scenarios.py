"""Projections and scenarios over quarters, for any number of clients in one job.

Horizons are exploded beside each client and running products are windows or
folds over that client's few quarters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, clip, projection_quarter_end, rate_closed

# Recovery quarters, plateau quarters and target ratio of each curve.
CURVES = {"v_shape": (2, 0, 1.0), "u_shape": (4, 1, 1.0), "l_shape": (8, 2, 0.85)}
SEVERITY = {"mild": 0.75, "moderate": 1.0, "severe": 1.35}
# growth, level, volatility multiplier, confidence
SHOCKS = {"best": (0.04, 0.02, 0.8, 0.05), "base": (0.0, 0.0, 1.0, 0.0), "worst": (-0.05, -0.03, 1.3, -0.08)}
# client, competitor growth, industry expansion, entrant multipliers
ASSUMPTIONS = {"conservative": (0.98, 1.05, 0.95, 1.20), "base": (1.0, 1.0, 1.0, 1.0), "aggressive": (1.03, 0.95, 1.05, 0.80)}


def quarters(df: DataFrame, horizon: int, name: str = "quarter") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def blend(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are there; null if none is."""
    total = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for x, w in parts[1:]), F.when(parts[0][0].isNotNull(), F.lit(parts[0][1])).otherwise(F.lit(0.0)))
    value = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
    return F.try_divide(value, total)


def base_projection(df: DataFrame, horizon: int = 8) -> DataFrame:
    """df: client, last_value, last_date, growth, industry, gdp -> a row per quarter with the compounded revenue."""
    g = blend([(F.col("growth"), 0.6), (F.col("industry"), 0.3), (F.col("gdp"), 0.1)])
    out = quarters(df.withColumn("blended", g), horizon)
    return out.select("client", "quarter", projection_quarter_end(F.col("last_date"), F.col("quarter")).alias("period_end"), "blended", (F.col("last_value") * F.pow(1 + F.coalesce("blended", F.lit(0.0)), "quarter")).alias("revenue"))


def project_from_growth(df: DataFrame, last: str, growth: str) -> DataFrame:
    """projected: levels reached by an array of growth rates; a null rate gives a null and keeps the level."""
    start = F.struct(F.col(last).cast("double").alias("level"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        level = F.when(g.isNull(), acc["level"]).otherwise(acc["level"] * (1 + g))
        return F.struct(level.alias("level"), F.concat(acc["out"], F.array(F.when(g.isNotNull(), level))).alias("out"))

    return df.withColumn("projected", F.aggregate(growth, start, step, lambda a: a["out"]))


def erosion(df: DataFrame, horizon: int = 8, severity: str = "moderate", exponential: bool = False, cap: float = 0.99) -> DataFrame:
    """df: client, share (ratio or percentage), score, industry_growth, factor -> per quarter erosion, growth, share.

    Effective erosion is factor x vulnerability x severity, held to 0..0.95.
    """
    vulnerable = F.round((100 - clip(F.coalesce("score", F.lit(50.0)), 0.0, 100.0)) / 100, 6)
    effective = clip(F.coalesce("factor", F.lit(0.0)) * vulnerable * SEVERITY[severity], 0.0, 0.95)
    percent = (F.col("share") > 1) & (F.col("share") <= 100)
    fraction = F.least(F.when(percent, F.col("share") / 100).otherwise(F.greatest("share", F.lit(0.0))), F.lit(1.0))
    out = quarters(df.withColumns({"__e": effective, "__f": fraction, "__p": percent}), horizon)
    t = F.col("quarter")
    grown = 1 - F.exp(-F.col("__e") * t) if exponential else F.col("__e") * t
    out = out.withColumn("erosion", clip(grown, 0.0, min(0.999999, cap)))
    w = Window.partitionBy("client").orderBy("quarter")
    step = clip(F.col("erosion") - F.coalesce(F.lag("erosion").over(w), F.lit(0.0)), 0.0, 0.999999)
    g = F.coalesce("industry_growth", F.lit(0.0))
    growth = F.greatest(F.when(g >= 0, g * (1 - F.col("erosion"))).otherwise(g * (1 + F.col("erosion"))), F.lit(-0.95))
    out = out.withColumns({"__d": step, "growth": growth})
    share = clip(F.col("__f") * F.exp(F.sum(F.ln(1 - F.col("__d"))).over(w.rowsBetween(Window.unboundedPreceding, 0))), 0.0, 1.0)
    return out.withColumn("__s", share).select("client", "quarter", "erosion", "growth", F.when(F.col("__p"), F.col("__s") * 100).otherwise(F.col("__s")).alias("share"), F.col("__f").alias("start_share"), F.col("__s").alias("share_fraction"), g.alias("industry_growth"))


def erosion_impact(curve: DataFrame) -> DataFrame:
    """Per client: half the loss of growth plus half the loss of share, in percent, never below 0."""
    a = curve.groupBy("client").agg(F.avg("industry_growth").alias("__b"), F.avg("growth").alias("__g"), F.max("start_share").alias("__s"), F.max_by("share_fraction", "quarter").alias("__e"))
    loss_g = (F.col("__b") - F.col("__g")) / F.greatest(F.abs("__b"), F.lit(GUARD))
    loss_s = (F.col("__s") - F.col("__e")) / F.greatest(F.abs("__s"), F.lit(GUARD))
    return a.select("client", (F.greatest(F.lit(0.0), 0.5 * loss_g + 0.5 * loss_s) * 100).alias("impact_pct"))


def recovery_multiplier(quarter: Column, trough: Column, shock: int, curve: str) -> Column:
    """1 down to the trough over `shock` quarters (a single shock quarter stays at 1), plateau, then the ramp."""
    recovery, plateau, target = CURVES[curve]
    if curve != "l_shape":
        target = max(1.0, target)
    down = F.lit(1.0) if shock <= 1 else 1 + (trough - 1) * (quarter - 1) / (shock - 1)
    ramp = trough + (target - trough) * F.least(F.lit(1.0), (quarter - shock - plateau) / float(recovery))
    if curve == "l_shape":
        ramp = F.least(ramp, F.lit(target))
    if shock == 0:
        return F.lit(1.0)
    return F.when(quarter <= shock, down).when(quarter <= shock + plateau, trough).otherwise(ramp)


def recession(df: DataFrame, curve: str = "u_shape", shock: int = 2) -> DataFrame:
    """df: client, quarter, revenue, multiplier (the trough) -> revenue under the shock."""
    m = recovery_multiplier(F.col("quarter"), F.col("multiplier"), shock, curve)
    return df.select("client", "quarter", "revenue", m.alias("recovery"), (F.col("revenue") * m).alias("stressed"))


def recession_impact(stressed: DataFrame, shock: int = 2, threshold: float = 0.98) -> DataFrame:
    """Per client: change of total revenue in percent, and the first quarter after the shock back at the threshold."""
    ok = (F.col("quarter") > shock) & (F.abs("revenue") > 1e-12) & (F.try_divide("stressed", "revenue") >= threshold)
    a = stressed.groupBy("client").agg(F.sum("revenue").alias("__b"), F.sum("stressed").alias("__s"), F.min(F.when(ok, F.col("quarter"))).alias("__q"))
    return a.select("client", ((F.col("__s") - F.col("__b")) / F.greatest(F.abs("__b"), F.lit(GUARD)) * 100).alias("net_impact_pct"),
                    F.when(F.col("__q").isNull(), "not_recovered_within_horizon").otherwise(F.concat(F.col("__q").cast("string"), F.lit("Q"))).alias("recovery_time"))


def macro_shock(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Contraction and rate rise from the last two rows of each metric: metric, period_end, value.

    Values in 1..500 are percentages first, as everywhere in this rule.
    """
    name = F.lower(F.trim("metric"))
    kind = F.when(name.isin("gdp", "gdp_growth", "gdp_growth_rate"), "gdp").when(name.isin("policy_rate", "interest_rate", "policy_interest_rate"), "rate")
    w = Window.partitionBy(*by, "kind").orderBy("period_end")
    r = rows.withColumn("kind", kind).where("kind is not null and value is not null").withColumn("v", rate_closed(F.col("value")))
    r = r.withColumns({"__p": F.lag("v").over(w), "__l": F.lead("v").over(w).isNull()}).where("__l and __p is not null")
    gdp = F.greatest(F.lit(0.0), -(F.col("v") - F.col("__p")) / F.greatest(F.abs("__p"), F.lit(1e-12)))
    rate = F.greatest(F.lit(0.0), F.col("v") - F.col("__p"))
    return r.groupBy(*by).agg(F.max(F.when(F.col("kind") == "gdp", gdp)).alias("gdp_contraction"), F.max(F.when(F.col("kind") == "rate", rate)).alias("rate_spike"))


def competitor_growth(df: DataFrame, rates: str, horizon: int) -> DataFrame:
    """client, competitor, rates -> a row per quarter; a short array goes on with its last rate. Percentages are scaled."""
    q = quarters(df, horizon)
    rate = F.coalesce(F.try_element_at(rates, F.col("quarter")), F.try_element_at(rates, F.lit(-1)), F.lit(0.0))
    return q.withColumn("rate", rate_closed(rate)).drop(rates)


def market_share(clients: DataFrame, competitors: DataFrame, industry: DataFrame, scenario: str = "base", entrant: float = 0.0, expansion: float = 0.0) -> DataFrame:
    """Client share and rank per quarter.

    clients: client, quarter, revenue. competitors: client, competitor, quarter,
    rate. industry: client, industry (its size; the first revenue is a tenth of
    it where neither is positive). What the client leaves of the industry is
    split evenly among the competitors, who then grow; the industry expands and
    an entrant takes a part of it; the market is the industry, or its members
    where they are more. Equal revenues do not outrank the client.
    """
    kc, kg, ke, kn = ASSUMPTIONS[scenario]
    own = clients.select("client", "quarter", (F.greatest("revenue", F.lit(0.0)) * kc).alias("own"))
    first = own.groupBy("client").agg(F.min_by("own", "quarter").alias("__o")).join(industry, "client")
    size = F.greatest(F.coalesce("industry", F.lit(0.0)), F.lit(0.0))
    whole = F.greatest(size, F.col("__o"))
    whole = F.when(whole > 0, whole).otherwise(1.0)
    first = first.select("client", size.alias("__size"), F.greatest(F.lit(0.0), whole - F.col("__o")).alias("__pool"))
    w = Window.partitionBy("client", "competitor").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(F.ln(1 + F.greatest(F.col("rate") * kg, F.lit(-0.95)))).over(w))
    rivals = competitors.withColumn("__g", grown).join(own, ["client", "quarter"]).join(first, "client")
    n = F.count(F.lit(1)).over(Window.partitionBy("client", "quarter"))
    rivals = rivals.withColumn("level", F.col("__g") * F.col("__pool") / n)
    met = rivals.groupBy("client", "quarter").agg(F.sum("level").alias("rivals"), F.count_if(F.round("level", 9) > F.round("own", 9)).alias("__above"))
    a = own.join(first, "client").join(met, ["client", "quarter"], "left")
    a = a.withColumn("__size", F.col("__size") * F.pow(F.lit(1 + expansion * ke), F.col("quarter")))
    a = a.withColumns({"rivals": F.coalesce("rivals", F.lit(0.0)), "entrant": max(0.0, entrant * kn) * F.col("__size")})
    market = F.greatest(F.col("__size"), F.col("own") + F.col("rivals") + F.col("entrant"))
    rank = 1 + F.coalesce("__above", F.lit(0)) + F.when(F.round("entrant", 9) > F.round("own", 9), 1).otherwise(0)
    out = a.select("client", "quarter", F.when(market > GUARD, F.col("own") / market).alias("share"), rank.alias("rank"), (F.col("entrant") > 0).alias("__e"))
    start = F.first("share").over(Window.partitionBy("client").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({"share_change": F.col("share") - start, "entrant_active": F.max("__e").over(Window.partitionBy("client"))}).drop("__e")


def competitive_shift(shares: DataFrame, competitors: DataFrame, rank_weight: float = 0.5, share_weight: float = 0.5) -> DataFrame:
    """Per client of market_share(): share change in points, and half the ranks gained over the rivals plus half the relative share change."""
    n = competitors.groupBy("client").agg(F.count_distinct("competitor").alias("__n"))
    a = shares.groupBy("client").agg(
        F.min_by("share", "quarter").alias("__s0"), F.max_by("share", "quarter").alias("__s1"), F.min_by("rank", "quarter").alias("__r0"), F.max_by("rank", "quarter").alias("__r1"),
        F.max(F.col("entrant_active").cast("int")).alias("__e"),
    )
    rivals = F.greatest(F.lit(1), F.coalesce("__n", F.lit(0)) + F.col("__e"))
    index = rank_weight * (F.col("__r0") - F.col("__r1")) / rivals + share_weight * (F.col("__s1") - F.col("__s0")) / F.greatest(F.abs("__s0"), F.lit(GUARD))
    return a.join(n, "client", "left").select("client", ((F.col("__s1") - F.col("__s0")) * 100).alias("share_delta"), index.alias("shift_index"))


def scenario_grid(df: DataFrame, periods: int = 1, low: float = 0.2, high: float = 1.0) -> DataFrame:
    """df: entity, latest, growth, anomaly_penalty, correlation_penalty, confidence -> best, base and worst case."""
    shocks = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(g).alias("dg"), F.lit(l).alias("dl"), F.lit(v).alias("vm"), F.lit(c).alias("dc")) for n, (g, l, v, c) in SHOCKS.items()))
    x = df.select("*", F.inline(shocks))
    growth = F.coalesce("growth", F.lit(0.0)) + F.col("dg") - F.col("anomaly_penalty") * F.col("vm")
    value = F.col("latest") * F.pow(1 + growth + F.col("dl"), F.lit(periods))
    return x.select("entity", "scenario", growth.alias("projected_growth"), value.alias("projected_value"), clip(F.col("confidence") + F.col("dc") - 0.5 * F.col("correlation_penalty"), low, high).alias("confidence"))


def scenario_risk(df: DataFrame, downside: float = 0.7, drawdown: float = 0.3, upside: float = 0.4) -> DataFrame:
    """df: client, quarter, base, scenario -> risk 0..100 from mean shortfall, worst drawdown and mean upside."""
    rel = F.try_divide(F.col("scenario") - F.col("base"), F.greatest(F.abs("base"), F.lit(GUARD)))
    peak = F.max("scenario").over(Window.partitionBy("client").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumns({"__d": F.greatest(F.lit(0.0), -rel), "__u": F.greatest(F.lit(0.0), rel), "__w": F.greatest(F.lit(0.0), (peak - F.col("scenario")) / F.greatest(F.abs(peak), F.lit(GUARD)))})
    a = x.groupBy("client").agg(F.avg("__d").alias("downside"), F.avg("__u").alias("upside"), F.max("__w").alias("drawdown"))
    return a.select("client", "downside", "upside", "drawdown", clip((downside * F.col("downside") + drawdown * F.col("drawdown") - upside * F.col("upside")) * 100, 0.0, 100.0).alias("risk"))


def orchestrate(base: DataFrame, curve: str = "u_shape", shock: int = 2) -> DataFrame:
    """client, quarter, revenue, erosion, multiplier -> revenue of base, erosion, recession and combined cases, one pass."""
    m = recovery_multiplier(F.col("quarter"), F.col("multiplier"), shock, curve)
    cases = F.array(*(
        F.struct(F.lit(n).alias("case"), (F.col("revenue") * (1 - F.col("erosion") if e else F.lit(1.0)) * (m if r else F.lit(1.0))).alias("value"))
        for n, e, r in (("base", False, False), ("erosion", True, False), ("recession", False, True), ("combined", True, True))
    ))
    return base.select("client", "quarter", F.col("revenue").alias("base"), F.inline(cases))
