"""Exact order statistics without a task that holds a whole group.

Values are counted by octave, by 32,768 steps within the octave, and by value.
Offsets run over the counts: octaves of a group (some 4,200 at most), steps of
an octave (32,768 at most), values of a step. The steps do not depend on the
data, so both sides of a join see the same ones and nothing need be kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 32_768


def _octave(v: Column) -> Column:
    """Grows with v: the sign and the power of two of a double."""
    power = F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-1_100)).cast("int")
    return F.when(v == 0, F.lit(0)).when(F.isnan(v), F.lit(9_999)).when(F.abs(v) == float("inf"), F.signum(v).cast("int") * 9_000).otherwise(F.signum(v).cast("int") * (power + 1_200))


def _step(v: Column, octave: Column) -> Column:
    """Grows with v within an octave."""
    inner = F.abs(v) * F.pow(F.lit(2.0), (1_200 - F.abs(octave)).cast("double")) * _STEPS
    return F.when((octave == 0) | (F.abs(octave) >= 9_000), F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * F.floor(inner))


def value_ranks(df: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """keys, value, same, below, n of each distinct non-null value in its group: rows that have it, rows below it, all rows."""
    keys = list(keys)
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("same"))
    counts = counts.withColumn("__o", _octave(v.cast("double"))).withColumn("__s", _step(v.cast("double"), F.col("__o")))
    steps = counts.groupBy(*keys, "__o", "__s").agg(F.sum("same").alias("__c"))
    octaves = steps.groupBy(*keys, "__o").agg(F.sum("__c").alias("__c"))
    before = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, by, at: F.coalesce(F.sum(c).over(before(by, at)), F.lit(0))
    octaves = octaves.select(*keys, "__o", sum_before("__c", keys, "__o").alias("__below_o"), F.sum("__c").over(Window.partitionBy(*keys)).alias("n"))
    steps = steps.select(*keys, "__o", "__s", sum_before("__c", [*keys, "__o"], "__s").alias("__below_s"))
    inside = counts.withColumn("__below", sum_before("same", [*keys, "__o", "__s"], value))
    placed = _joined(_joined(inside, steps, [*keys, "__o", "__s"]), octaves, [*keys, "__o"])
    return placed.select(*keys, value, "same", (F.col("__below") + F.col("__below_s") + F.col("__below_o")).alias("below"), "n")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls meet; the columns of the right side come without the keys."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = reduce(Column.__and__, (left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on))
    return left.join(renamed, same, how).drop(*(f"__r_{c}" for c in on))


def medians(ranks: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """keys, median from value_ranks' rows: the mean of the two middle values."""
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("same")), F.col(value)))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return ranks.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def with_ranks(df: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """df with __same, __below, __n and __median of each row's value in its group; null where the value is null."""
    ranks = value_ranks(df, keys, value)
    named = ranks.withColumnsRenamed({"same": "__same", "below": "__below", "n": "__n"})
    middle = medians(ranks, keys, value).withColumnRenamed("median", "__median")
    # A null value meets no rank, as ranks have none.
    return _joined(_joined(df, named, [*keys, value], "left"), middle, list(keys), "left")


def global_rank(df: DataFrame, by: Column, name: str = "rank") -> DataFrame:
    """df with the competition rank of `by` (descending) over all rows."""
    one = df.withColumns({"__by": by, "__all": F.lit(0)})
    ranks = value_ranks(one, ("__all",), "__by").select("__by", (F.col("n") - F.col("below") - F.col("same") + 1).cast("int").alias(name))
    return _joined(one.drop("__all"), ranks, ["__by"], "left").drop("__by")


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df with aggregates over all its rows beside each row: one aggregate row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in totals.items()))))  # one row
