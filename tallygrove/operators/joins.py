"""Join operators: as-of and interval joins, peers, observations, scope resolution.

The as-of join is a union and a window: both sides are sorted once by key and
time, and the last row at or before each time is carried forward. Nothing is
multiplied, however many intervals lie before a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD
from tallygrove.operators.order import with_totals


def asof(left: DataFrame, right: DataFrame, at: str, start: str, by: tuple[str, ...] = (), values: tuple[str, ...] = ("value",), end: str | None = None) -> DataFrame:
    """left with `values` of the last right row whose `start` is at or before `at`.

    With `end`, the row counts only if it reaches `at`: the latest start decides
    first, so an earlier, longer interval never stands in. Right rows of equal
    start are ranked by their values, greatest last. Times without a row get nulls.
    """
    keep = [c for c in left.columns]
    payload = F.struct(*values, *([end] if end else []))
    l = left.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*keep).alias("__l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__r"))
    r = right.select(*by, F.col(start).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), payload.alias("__r"))
    order = Window.partitionBy(*by).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("__m", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    ok = F.col("__m").isNotNull() & (F.col(f"__m.{end}") >= F.col("__t") if end else F.lit(True))
    return both.select("__l.*", *(F.when(ok, F.col(f"__m.{v}")).alias(v if v not in keep else f"{v}_right") for v in values))


def latest_row(df: DataFrame, keys, order: str) -> DataFrame:
    """The row with the greatest `order` per key; ties keep the lowest of the remaining columns."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *rest)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def with_previous(df: DataFrame, key: str, period: str, columns: tuple[str, ...], months: int = 1) -> DataFrame:
    """Each row beside the row of the window just before it, found by equality on the shifted period."""
    before = df.select(key, F.add_months(period, months).alias(period), *(F.col(c).alias(f"previous_{c}") for c in columns))
    return df.join(before, [key, period], "left")


def peers_by_size(df: DataFrame, entity: str, size: str, low: float = 0.5, high: float = 2.0, least: int = 3, most: int = 10) -> DataFrame:
    """client, peer, place: peers within low..high times the client's size, or all if fewer than `least` are.

    Sizes are bucketed by powers of high / low, and a client meets the buckets
    that its band can reach, so near sizes are found by equality. Clients with
    too few peers in the band take the first `most` entities by name, which is a
    list of that length and not a join of all with all.
    """
    width = high / low
    bucket = lambda x: F.floor(F.ln(x) / F.ln(F.lit(width)))
    rows = df.select(F.col(entity).alias("peer"), F.col(size).alias("peer_size")).where("peer_size > 0").withColumn("__b", bucket(F.col("peer_size")))
    client = df.select(F.col(entity).alias("client"), F.col(size).alias("client_size")).where("client_size > 0")
    reach = client.withColumn("__b", F.explode(F.sequence(bucket(F.col("client_size") * low).cast("long"), bucket(F.col("client_size") * high).cast("long"))))
    near = reach.join(rows, "__b").where((F.col("client") != F.col("peer")) & F.col("peer_size").between(F.col("client_size") * low, F.col("client_size") * high))
    counted = near.groupBy("client").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    enough = near.join(counted.select("client"), "client", "left_semi").select("client", "peer")
    first = df.select(F.col(entity).alias("peer")).distinct().orderBy("peer").limit(most + 1).agg(F.collect_list("peer").alias("__p"))  # most + 1 names
    short = df.select(F.col(entity).alias("client")).join(counted, "client", "left_anti").crossJoin(F.broadcast(first))  # one row
    rest = short.select("client", F.explode("__p").alias("peer")).where("client <> peer")
    w = Window.partitionBy("client").orderBy("peer")
    return enough.union(rest).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def size_band(revenue: Column) -> Column:
    return F.when(revenue < 1e6, "small").when(revenue < 1e7, "medium").otherwise("large")


def peers_in_band(df: DataFrame, client_band: str, band: str = "band") -> DataFrame:
    """Rows of the client's band; all rows if none is in it."""
    counted = with_totals(df, __m=F.count(F.when(F.col(band) == client_band, 1)))
    return counted.where((F.col("__m") == 0) | (F.col(band) == client_band)).drop("__m")


def observations(client: DataFrame, peers: DataFrame) -> DataFrame:
    """client and peer values of one metric; confidence 0.35 where a value is not finite.

    Both: entity, metric, unit, scale, value, confidence. Scales are converted
    between ratio and percentage; other mismatches become a reason.
    """
    c = client.select("metric", F.col("unit").alias("cu"), F.col("scale").alias("cs"), F.col("value").alias("client_value"))
    j = peers.join(c, "metric")
    value = F.when(F.col("scale") == F.col("cs"), F.col("value")).when((F.col("scale") == "percentage") & (F.col("cs") == "ratio"), F.col("value") / 100).when((F.col("scale") == "ratio") & (F.col("cs") == "percentage"), F.col("value") * 100)
    reason = F.when(F.col("unit") != F.col("cu"), "unit_mismatch").when(value.isNull(), "scale_mismatch").when(F.isnan(value), "non_finite_value")
    return j.select("entity", "metric", "client_value", F.when(reason.isNull(), value).alias("peer_value"), reason.alias("reason"), F.when(reason.isNull(), F.lit(1.0)).otherwise(0.35).alias("confidence"))


def direction(metric: Column) -> Column:
    return F.when(F.lower(metric).rlike("churn|cac|risk|cost"), "lower_is_better").otherwise("higher_is_better")


def resolve_scope(rows: DataFrame, scope: DataFrame, tenant: str = "legacy") -> tuple[DataFrame, DataFrame]:
    """rows with entity_id, and the new scope rows for entities not yet known.

    A new id is the hash of tenant and normalised name, so reruns and parallel
    writers give the same one.
    """
    key = F.lower(F.trim("entity"))
    keyed = rows.withColumn("entity_key", key)
    known = scope.where(F.col("tenant") == tenant).select("entity_key", F.col("entity_id").alias("__id"))
    fresh = keyed.select("entity_key").distinct().join(known, "entity_key", "left_anti").select(
        F.lit(tenant).alias("tenant"), "entity_key", F.sha2(F.concat_ws(":", F.lit(tenant), "entity_key").cast("binary"), 256).alias("entity_id")
    )
    new_id = F.sha2(F.concat_ws(":", F.lit(tenant), "entity_key").cast("binary"), 256)
    return keyed.join(known, "entity_key", "left").withColumn("entity_id", F.coalesce("__id", new_id)).drop("__id"), fresh


def canonical_names(series: DataFrame, aliases: DataFrame, pack: str) -> DataFrame:
    """series with the canonical name of its metric in the pack, by a join on the alias table (a dozen packs)."""
    own = aliases.where(F.col("pack") == pack).select(F.col("alias").alias("metric"), "canonical")
    return series.join(F.broadcast(own), "metric", "left")  # at most a pack's dozen names


# Pairs of signals, how they should move, and how grave a conflict is.
CONFLICT_RULES = (
    ("revenue_growth_delta", "churn_delta", "opposite", 0.9),
    ("revenue_growth_delta", "conversion_delta", "same", 0.7),
    ("traffic_delta", "revenue_growth_delta", "same", 0.6),
    ("churn_delta", "active_customer_delta", "opposite", 0.8),
    ("slope", "deviation_percentage", "same", 0.5),
    ("revenue_growth_delta", "cac_delta", "opposite", 0.6),
    ("conversion_delta", "churn_delta", "opposite", 0.7),
    ("ltv_delta", "churn_delta", "opposite", 0.8),
    ("revenue_growth_delta", "slope", "same", 0.6),
    ("revenue_growth_delta", "active_customer_delta", "same", 0.7),
    ("ltv_delta", "cac_delta", "opposite", 0.7),
)


def signal_conflicts(signals: DataFrame, per_unit: float = 0.12, most: float = 0.6) -> DataFrame:
    """Per entity: rules evaluated, conflicts, total severity, penalty, uncertainty.

    signals: entity, signal, value. Two equi-joins with the eleven rules.
    """
    rules = signals.sparkSession.createDataFrame(CONFLICT_RULES, "a string, b string, expected string, severity double")
    known = signals.where("value is not null")
    sign = F.when(F.col("value") > GUARD, 1).when(F.col("value") < -GUARD, -1).otherwise(0)
    side = known.select("entity", F.lower(F.trim("signal")).alias("signal"), sign.alias("sign"))
    a = side.select("entity", F.col("signal").alias("a"), F.col("sign").alias("sa"))
    b = side.select("entity", F.col("signal").alias("b"), F.col("sign").alias("sb"))
    met = a.join(F.broadcast(rules), "a").join(b, ["entity", "b"])  # eleven rules
    clash = (F.col("sa") * F.col("sb") != 0) & F.when(F.col("expected") == "same", F.col("sa") != F.col("sb")).otherwise(F.col("sa") == F.col("sb"))
    out = met.withColumn("__c", clash).groupBy("entity").agg(
        F.count(F.lit(1)).alias("rules_evaluated"), F.count(F.when(F.col("__c"), 1)).alias("conflicts"),
        F.coalesce(F.sum(F.when(F.col("__c"), F.col("severity"))), F.lit(0.0)).alias("total_severity"), F.coalesce(F.max(F.when(F.col("__c"), F.col("severity"))), F.lit(0.0)).alias("__m"),
    )
    return out.select("entity", "rules_evaluated", "conflicts", "total_severity", F.least(F.lit(most), F.col("total_severity") * per_unit).alias("penalty"), (F.col("__m") >= 0.8).alias("uncertain"))


def temporal_conflicts(ccf: DataFrame, series: DataFrame) -> DataFrame:
    """Significant lagged pairs of metrics that go different ways, from the first to the last value of each, whatever the sign of r.

    ccf (entity, a, b, lag, r, significant), series (entity, metric, seq, value). A metric that ends where it began has no way.
    """
    ends = series.groupBy("entity", "metric").agg(F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"))
    way = ends.select("entity", "metric", F.signum(F.col("last") - F.col("first")).alias("way"))
    a = way.select("entity", F.col("metric").alias("a"), F.col("way").alias("sa"))
    b = way.select("entity", F.col("metric").alias("b"), F.col("way").alias("sb"))
    pairs = ccf.where("significant and lag <> 0").join(a, ["entity", "a"]).join(b, ["entity", "b"])
    named = lambda c: F.when(F.col(c) > 0, "up").otherwise("down")
    return pairs.where(F.col("sa") * F.col("sb") < 0).select("entity", "a", "b", "lag", "r", named("sa").alias("way_a"), named("sb").alias("way_b"))
