"""Macro indicators: landed observations to validated intervals, and their use beside KPIs.

There is no network: providers read JSON files that something else has landed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrove.functions.columns import GUARD, deflate, fisher_real, frequency, quarter_end, rate_adjusted_efficiency
from tallygrove.operators.joins import asof
from tallygrove.operators.windows import compounded, forward_fill
from tallygrove.sources.merge import by_month, merge, read_target, target_exists

MACRO_KEY = ("country", "metric", "frequency", "period_end")


# Providers: (spark, path) -> country, metric, period_start, period_end, value (text).
def dated_observations(spark: SparkSession, path: str, country: str, metric: str) -> DataFrame:
    """JSON lines {date, value}: one-day intervals; blanks and "." are no observation."""
    raw = spark.read.schema("date string, value string").json(path)
    ok = raw.where(F.col("value").isNotNull() & ~F.trim("value").isin("", "."))
    day = F.to_date("date")
    return ok.select(F.lit(country).alias("country"), F.lit(metric).alias("metric"), day.alias("period_start"), day.alias("period_end"), "value")


def yearly_observations(spark: SparkSession, path: str, country: str, metric: str, limit: int = 1000) -> DataFrame:
    """JSON lines {date: year, value}: whole-year intervals, the newest `limit` per metric."""
    raw = spark.read.schema("date string, value string").json(path).where("value is not null")
    year = F.col("date").try_cast("int")
    rows = raw.select(F.lit(country).alias("country"), F.lit(metric).alias("metric"), F.make_date(year, F.lit(1), F.lit(1)).alias("period_start"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"), "value").where("period_end is not null")
    w = Window.partitionBy("country", "metric").orderBy(F.desc("period_end"))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def unsupported(*_args) -> DataFrame:
    raise NotImplementedError("this provider is not supported")


PROVIDERS: dict[str, Callable[..., DataFrame]] = {"dated": dated_observations, "yearly": yearly_observations, "imf": unsupported}


def provider(name: str) -> Callable[..., DataFrame]:
    """A provider by its name, in any case."""
    try:
        return PROVIDERS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown macro provider {name!r}") from None


def transform_observations(raw: DataFrame, expected: str) -> DataFrame:
    """raw with frequency, number and error.

    A single day stands for its month (or quarter, as expected); an interval of
    another frequency, bounds in the wrong order and text values are errors.
    """
    one_day = F.col("period_start") == F.col("period_end")
    start = F.when(one_day, F.trunc("period_start", "month" if expected == "M" else "quarter")).otherwise(F.col("period_start"))
    end = F.when(one_day, F.last_day("period_end") if expected == "M" else quarter_end(F.col("period_end"))).otherwise(F.col("period_end"))
    out = raw.withColumns({"__s": start, "__e": end, "number": F.col("value").try_cast("decimal(20,6)")})
    freq = frequency(F.col("__s"), F.col("__e"))
    error = (
        F.when(F.col("__s").isNull() | F.col("__e").isNull(), "missing_bounds").when(F.col("__s") > F.col("__e"), "bounds_reversed")
        .when(freq != expected, "frequency").when(F.col("number").isNull(), "value")
    )
    return out.select("country", "metric", F.col("__s").cast("date").alias("period_start"), F.col("__e").cast("date").alias("period_end"), freq.alias("frequency"), "number", error.alias("error"))


def country_rows(rows: DataFrame, country: str) -> DataFrame:
    """Rows of the country and rows without one."""
    c = F.upper(F.trim("country"))
    return rows.where((c == country.upper()) | F.col("country").isNull() | (F.trim("country") == ""))


def is_inflation(metric: Column) -> Column:
    return F.lower(metric).rlike("cpi|inflation|price_index|deflator")


# Use.
def align(periods: DataFrame, macro: DataFrame, at: str = "period_end", by: tuple[str, ...] = (), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Each period end with the last interval that starts by then, if that interval reaches it."""
    return asof(periods, macro, at, "period_start", by, values, "period_end")


def align_or(periods: DataFrame, macro: DataFrame, scalar: float, at: str = "period_end") -> DataFrame:
    """As align(); periods without an interval get the scalar."""
    return align(periods, macro, at).withColumn("value", F.coalesce("value", F.lit(scalar)))


def real_growth(kpis: DataFrame, inflation: DataFrame, gdp: DataFrame, policy: DataFrame, at: str = "period_end") -> DataFrame:
    """kpis (entity, period_end, growth) with inflation, gdp, policy_rate, real_growth, vs_gdp and efficiency.

    The macro tables (period_start, period_end, value) are one row a period, so
    the three as-of joins run over distinct period ends only.
    """
    dates = kpis.select(at).distinct()
    a = align(dates, inflation, at).withColumnRenamed("value", "inflation")
    b = align(dates, gdp, at).withColumnRenamed("value", "gdp")
    c = align(dates, policy, at).withColumnRenamed("value", "policy_rate")
    macro = a.join(b, at).join(c, at)
    real = fisher_real(F.col("growth"), F.col("inflation"))
    out = kpis.join(macro, at, "left").withColumn("real_growth", real)
    return out.withColumns({"vs_gdp": F.col("real_growth") - F.col("gdp"), "efficiency": rate_adjusted_efficiency(F.col("real_growth"), F.col("policy_rate"))})


def cpi_inflation(cpi: DataFrame, keys=("entity",)) -> DataFrame:
    """inflation: change of the (forward-filled) index."""
    filled = forward_fill(cpi, "cpi", keys, "__c")
    before = F.lag("__c").over(Window.partitionBy(*keys).orderBy("seq"))
    return filled.withColumn("inflation", F.try_divide(F.col("__c"), before) - 1).drop("__c")


def inflation_adjusted(series: DataFrame, keys=("entity",)) -> DataFrame:
    """series with cpi -> inflation, growth, real_growth, real value (first index as base) and compounded inflation."""
    w = Window.partitionBy(*keys).orderBy("seq")
    x = cpi_inflation(series, keys)
    base = F.first("cpi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    growth = (F.col("value") - F.lag("value").over(w)) / F.greatest(F.abs(F.lag("value").over(w)), F.lit(GUARD))
    x = x.withColumns({"growth": growth, "real_value": F.try_divide("value", F.try_divide(F.col("cpi"), base))})
    return compounded(x.withColumn("real_growth", fisher_real(F.col("growth"), F.col("inflation"))), "inflation", keys, "compounded_inflation")


def deflated_level(value: Column, inflation: Column) -> Column:
    return deflate(value, inflation)


def ingest_run(existing: DataFrame, raw: DataFrame, expected: str, version: int) -> tuple[DataFrame, DataFrame]:
    """(metrics with the new run put over the old, rejected rows): last wins within the run."""
    done = transform_observations(raw, expected)
    good = done.where("error is null").drop("error").withColumns({"version": F.lit(version), "_row": F.monotonically_increasing_id()})
    w = Window.partitionBy(*MACRO_KEY).orderBy(F.desc("version"), F.desc("_row"))
    both = existing.withColumn("_row", F.lit(-1).cast("long")).unionByName(good, allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "_row"), done.where("error is not null")


def merge_run(raw: DataFrame, target: str, expected: str, version: int) -> DataFrame:
    """Puts a run's observations into the metric table `target` and returns the rejected ones; last wins within the run.

    The table is partitioned by the month of period_end, so a run rewrites the months it has observations of. A
    run older than what is stored for a key leaves it.
    """
    spark = raw.sparkSession
    done = transform_observations(raw, expected)
    good = done.where("error is null").drop("error").withColumns({"version": F.lit(version), "_row": F.monotonically_increasing_id()})
    if target_exists(spark, target):
        newer = read_target(spark, target).where(F.col("version") > version).select(*MACRO_KEY)
        good = good.join(newer, list(MACRO_KEY), "left_anti")
    merge(good, target, MACRO_KEY, by_month("period_end"), "_row")
    return done.where("error is not null")
