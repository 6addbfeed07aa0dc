"""Top-k and set operations with defined ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, n: int, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The n greatest rows by `order`; n is held to 1..100000."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(max(1, min(100_000, n)))


def first_per_key(df: DataFrame, keys, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def select_metrics(series: DataFrame, least: int, most: int, preferred: tuple[str, ...] = ()) -> DataFrame:
    """Metrics of each entity with `least` points: preferred ones in their order, then the deepest, then by name."""
    depth = series.groupBy("entity", "metric").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    wish = F.lit(len(preferred))
    for i, name in reversed(list(enumerate(preferred))):
        wish = F.when(F.col("metric") == name, i).otherwise(wish)
    return first_per_key(depth, ["entity"], [wish, F.desc("n"), F.asc("metric")], most)


def strongest_weakest(scores: DataFrame) -> DataFrame:
    """Metric with the highest and the lowest score of each entity; ties go to the first name."""
    s = F.round("score", 9)
    return scores.groupBy("entity").agg(F.min_by("metric", F.struct(-s, F.col("metric"))).alias("strongest"), F.min_by("metric", F.struct(s, F.col("metric"))).alias("weakest"))


def within_period(df: DataFrame, start: str, end: str, low: str, high: str) -> DataFrame:
    """Rows whose period lies within [low, high]."""
    return df.where((F.col(start) >= F.lit(low).cast("date")) & (F.col(end) <= F.lit(high).cast("date")))


def distinct_ignoring_case(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The first spelling of each name."""
    w = Window.partitionBy(F.lower(F.trim(name))).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def without_domains(df: DataFrame, url: str, blocked: DataFrame) -> DataFrame:
    """Rows whose host is none of the blocked domains nor below one.

    A host's parents are exploded and anti-joined by equality, so the blocked
    list may be large.
    """
    host = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("")))
    parts = F.split("__h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = df.select(host.alias("__h")).distinct()
    bad = hosts.select("__h", F.explode(parents).alias("__d")).join(blocked.select(F.lower("domain").alias("__d")), "__d", "left_semi").select("__h").distinct()
    return df.withColumn("__h", host).join(bad, "__h", "left_anti").drop("__h")


def first_shared(left: DataFrame, right: DataFrame, candidates: tuple[str, ...], metric: str = "metric") -> DataFrame:
    """The first candidate that both sides have; no row if there is none."""
    both = left.select(metric).distinct().join(right.select(metric).distinct(), metric).where(F.col(metric).isin(*candidates))
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col(metric))
    return both.orderBy(place).limit(1)


def missing_required(series: DataFrame, required: tuple[str, ...], optional: tuple[str, ...]) -> DataFrame:
    """Names, sorted and comma-joined, that each entity lacks."""
    have = series.groupBy("entity").agg(F.collect_set("metric").alias("__h"))
    lacking = lambda names: F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, names)), "__h")), ",")
    return have.select("entity", lacking(required).alias("missing_required"), lacking(optional).alias("missing_optional"))


def override(base: DataFrame, over: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """All keys of both; where both have one, the value of `over`."""
    o = over.select(key, F.col(value).alias("__o"))
    return base.join(o, key, "full").select(key, F.coalesce("__o", value).alias(value))
