"""Aggregations over long facts: periods, dimensions, cohorts, weights, clusters.

Sums and counts combine on the map side; the dimension summary is one job over
grouping sets, so the facts are read once for all dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, clip, safe_divide

DIMENSIONS = ("region", "segment", "channel", "entity")


# Periods.
def in_period(ts: Column, start, end, closed: bool = False) -> Column:
    """Half-open [start, end) unless `closed`."""
    return (ts >= start) & (ts <= end if closed else ts < end)


def period_sum(value: Column) -> Column:
    """Null without rows, else the sum with nulls as zero."""
    return F.when(F.count(F.lit(1)) > 0, F.coalesce(F.sum(value), F.lit(0.0)))


def ordered_values(value: str = "value", ts: str = "ts", tie: str = "id") -> Column:
    """Non-null values in time order. One row per group must fit a task: use it per entity and month."""
    rows = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(ts, tie, value)))
    return F.transform(F.sort_array(rows), lambda x: x[value])


def distinct_on_latest(df: DataFrame, keys, order: tuple[str, ...]) -> DataFrame:
    """One row per key: the greatest by `order`; combines on the map side, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def date_range(df: DataFrame, keys=("entity",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count(F.lit(1)).alias("records"))


def record_count(df: DataFrame, entity: str | None = None, category: str | None = None) -> DataFrame:
    for col, want in (("entity", entity), ("category", category)):
        df = df if want is None else df.where(F.col(col) == want)
    return df.agg(F.count(F.lit(1)).alias("records"))


def arpu_snapshot(months: DataFrame) -> DataFrame:
    """Revenue of each month over the customers active in the month before (the newest snapshot before it)."""
    w = Window.partitionBy("entity").orderBy("month")
    snap = F.last("active", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return months.select("entity", "month", "revenue", snap.alias("snapshot"), safe_divide(F.col("revenue"), snap).alias("arpu"))


def dataset_hash(df: DataFrame, keys=("entity",)) -> DataFrame:
    """A digest of a group's rows that does not depend on their order.

    Row hashes are added, so no group is gathered; equal data give equal digests.
    """
    row = F.xxhash64("metric", F.col("value"), F.col("ts"))
    return df.groupBy(*keys).agg(F.sum(row.cast("decimal(20,0)")).alias("__s"), F.count(F.lit(1)).alias("rows")).select(
        *keys, "rows", F.sha2(F.concat_ws("|", "rows", F.col("__s").cast("string")).cast("binary"), 256).alias("digest")
    )


# Dimensions.
def dimension_summary(df: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """dimension, name, total, records, share (of the positive total), place: all dimensions in one pass."""
    view = df.select(*dimensions, "value")
    which = reduce(lambda acc, d: acc.when(F.expr(f"grouping({d}) = 0"), F.lit(d)), dimensions[1:], F.when(F.expr(f"grouping({dimensions[0]}) = 0"), F.lit(dimensions[0])))
    grouped = view.groupingSets([[F.col(d)] for d in dimensions], *dimensions).agg(
        which.alias("dimension"), F.coalesce(*dimensions).alias("name"), F.round(F.sum("value"), 2).alias("total"), F.count(F.lit(1)).alias("records")
    )
    return with_shares(grouped.select("dimension", "name", "total", "records"), ["dimension"])


def with_shares(df: DataFrame, keys) -> DataFrame:
    """share of the group's positive total, and place: by share, total, name."""
    w = Window.partitionBy(*keys)
    positive = F.greatest(F.col("total"), F.lit(0.0))
    share = F.coalesce(F.try_divide(positive, F.sum(positive).over(w)), F.lit(0.0))
    out = df.withColumn("share", share)
    return out.withColumn("place", F.row_number().over(w.orderBy(F.desc("share"), F.desc("total"), "name")))


def concentration(summary: DataFrame, keys=("dimension",)) -> DataFrame:
    """hhi of the shares rounded to six decimals, and 1 / hhi."""
    share = F.round("share", 6)
    h = summary.groupBy(*keys).agg(F.sum(share * share).alias("hhi"), F.count(F.lit(1)).alias("groups"))
    return h.withColumn("effective_groups", F.try_divide(F.lit(1.0), F.col("hhi")))


def extremes(conc: DataFrame) -> DataFrame:
    """The most and the least concentrated dimension; ties go by name."""
    return conc.agg(
        F.max_by("dimension", F.struct("hhi", "dimension")).alias("most_concentrated"), F.min_by("dimension", F.struct("hhi", "dimension")).alias("least_concentrated")
    )


def contributors(summary: DataFrame, top: int, keys=("dimension",)) -> DataFrame:
    """The first `top` and, marked as laggards, the last `top` of each dimension that are not among the first."""
    last = Window.partitionBy(*keys).orderBy(F.desc("place"))
    marked = summary.withColumn("__l", F.row_number().over(last))
    side = F.when(F.col("place") <= top, "top").when(F.col("__l") <= top, "laggard")
    return marked.withColumn("side", side).where("side is not null").drop("__l")


def metric_stats(df: DataFrame, keys) -> DataFrame:
    """n, mean, median, low, high and population deviation (0 for one value)."""
    return df.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("deviation"),
    )


def bundle_confidence(stages_ok: Column, signals: Column, mean_confidence: Column) -> Column:
    return 0.4 * stages_ok + 0.3 * F.least(signals / 10, F.lit(1.0)) + 0.3 * mean_confidence


def dataset_confidence(df: DataFrame, json: str = "metadata", path: str = "$._ingestion.schema_confidence") -> DataFrame:
    """Mean of a nested confidence held to 0..1; 1 without any."""
    each = clip(F.get_json_object(json, path).try_cast("double"), 0.0, 1.0)
    return df.agg(F.coalesce(F.avg(each), F.lit(1.0)).alias("confidence"))


# Weights.
def weighted_stats(df: DataFrame, keys, value: str = "value", weight: str = "weight") -> DataFrame:
    """Mean, deviation, median (first value whose cumulated weight reaches half) with weights held to 0..1."""
    w = clip(F.col(weight), 0.0, 1.0)
    ok = df.withColumn("__w", w).where((F.col("__w") > 0) & F.col(value).isNotNull())
    total = F.sum("__w").over(Window.partitionBy(*keys))
    norm = ok.withColumn("__w", F.col("__w") / total)
    upto = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    run = norm.withColumn("__c", F.sum("__w").over(upto))
    m = run.groupBy(*keys).agg(
        F.sum(F.col("__w") * F.col(value)).alias("mean"),
        F.sum(F.col("__w") * F.col(value) * F.col(value)).alias("__q"),
        F.min(F.when(F.round("__c", 12) >= 0.5, F.col(value))).alias("median"),
        F.count(F.lit(1)).alias("n"),
    )
    return m.select(*keys, "n", "mean", F.sqrt(F.greatest(F.col("__q") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("deviation"), "median")


def mad(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Median and median absolute deviation."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return df.join(med, list(keys)).groupBy(*keys, "median").agg(F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))


# Cohorts.
def cohort_activity(facts: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """cohort_key, cohort, seq (months since the cohort's first), active, retention, churn.

    A customer's cohort values come from its first order. retention is active
    over the first positive active count, held to 0..1.
    """
    first = facts.groupBy("customer").agg(F.min_by(F.struct("ts", "channel", "segment"), F.struct("ts", "id")).alias("f"))
    pairs = F.array(*(F.struct(F.lit(k).alias("cohort_key"), c.cast("string").alias("cohort")) for k, c in keys.items()))
    tagged = first.select("customer", F.inline(pairs))
    months = facts.select("customer", F.trunc("ts", "month").alias("month")).distinct()
    active = tagged.join(months, "customer").groupBy("cohort_key", "cohort", "month").agg(F.count(F.lit(1)).alias("active"))
    w = Window.partitionBy("cohort_key", "cohort").orderBy("month")
    base = F.first(F.when(F.col("active") > 0, F.col("active")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = active.withColumns({"seq": F.row_number().over(w) - 1, "retention": clip(safe_divide(F.col("active"), base), 0.0, 1.0)})
    before = F.lag("active").over(w)
    churn = F.coalesce(F.greatest(F.lit(0.0), safe_divide(before - F.col("active"), before)), F.lit(0.0))
    return out.withColumn("churn", churn)


def cohort_keys() -> dict[str, Column]:
    """signup_month, acquisition_channel and segment of a customer's first order."""
    return {"signup_month": F.date_format("f.ts", "yyyy-MM"), "acquisition_channel": F.col("f.channel"), "segment": F.col("f.segment")}


def cohort_summary(curves: DataFrame, least: int = 3) -> DataFrame:
    """Per cohort: points, decay (mean loss per step), lifetime (sum of retention), churn_acceleration, sparse."""
    w = Window.partitionBy("cohort_key", "cohort").orderBy("seq")
    drop = F.greatest(F.lag("retention").over(w) - F.col("retention"), F.lit(0.0))
    bend = F.col("churn") - 2 * F.lag("churn").over(w) + F.lag("churn", 2).over(w)
    return curves.withColumns({"__d": drop, "__b": bend}).groupBy("cohort_key", "cohort").agg(
        F.count(F.lit(1)).alias("points"), F.avg("__d").alias("decay"), F.sum("retention").alias("lifetime"), F.avg("__b").alias("churn_acceleration"),
        (F.count(F.lit(1)) < least).alias("sparse"),
    )


def cohort_overview(summary: DataFrame) -> DataFrame:
    """Per cohort key: means, the worst cohort (decay plus rising churn) and a risk hint."""
    badness = F.round(F.coalesce("decay", F.lit(0.0)) + F.greatest(F.coalesce("churn_acceleration", F.lit(0.0)), F.lit(0.0)), 9)
    out = summary.groupBy("cohort_key").agg(
        F.count(F.lit(1)).alias("cohorts"), F.avg("decay").alias("decay"), F.avg("lifetime").alias("lifetime"), F.avg("churn_acceleration").alias("churn_acceleration"),
        F.count(F.when(F.col("sparse"), 1)).alias("sparse"), F.min_by("cohort", F.struct(-badness, F.col("cohort"))).alias("worst_cohort"),
    )
    hint = (
        F.when((F.col("decay") >= 0.1) | (F.col("churn_acceleration") >= 0.05), "high")
        .when((F.col("decay") >= 0.05) | (F.col("churn_acceleration") >= 0.02), "moderate")
        .otherwise("low")
    )
    return out.withColumn("risk_hint", hint)


# Clusters.
def cluster_profile(df: DataFrame, cluster: str = "cluster", features=("growth", "churn", "risk", "ltv")) -> DataFrame:
    """Size and mean of each feature (nulls as zero) per cluster."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *(F.avg(F.coalesce(f, F.lit(0.0))).alias(f"avg_{f}") for f in features))


def drivers(root_causes: DataFrame, summary: DataFrame, top: int = 3) -> DataFrame:
    """entity, driver, kind: root causes and the top contributors of each dimension."""
    causes = root_causes.select("entity", F.explode("issues").alias("driver"), F.lit("root_cause").alias("kind"))
    best = summary.where(F.col("place") <= top).select(F.lit(None).cast("string").alias("entity"), F.concat_ws(":", "dimension", "name").alias("driver"), F.lit("contributor").alias("kind"))
    return causes.union(best)


# Scores of a dataset against category packs.
def metric_match_score(metrics: Column, core: Column) -> Column:
    """Share of core metrics that some metric contains or is contained in; 15% more from three matches, 30% from five."""
    hit = F.size(F.filter(core, lambda c: F.exists(metrics, lambda m: m.contains(c) | c.contains(m))))
    raw = hit / F.greatest(F.least(F.size(metrics), F.size(core)), F.lit(1))
    return F.least(F.lit(1.0), raw * F.when(hit >= 5, 1.3).when(hit >= 3, 1.15).otherwise(1.0))


def guarded_share(part: Column, total: Column) -> Column:
    return F.when(F.abs(total) > GUARD, part / total).otherwise(F.lit(0.0))
