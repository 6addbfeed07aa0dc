"""Batch jobs: ingest a file, compute KPIs, forecasts and risk, register what ran.

Jobs write tables by name, so a scheduler of any kind can call them; each is one
Spark job graph over all entities. A rerun on unchanged data computes nothing:
entities are compared by digest first.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.operators import aggregates as A
from tallygrove.operators import contexts as X
from tallygrove.operators import kpis as K
from tallygrove.operators import scoring as R
from tallygrove.operators import series as S
from tallygrove.operators import windows as W
from tallygrove.sources import ingest as I
from tallygrove.sources import mapping as M
from tallygrove.sources import merge as U
from tallygrove.sources import star
from tallygrove.sources.packs import churn_metric
from tallygrove.streaming.events import changed_entities


def record_job(spark: SparkSession, table: str, job: str, state: str, details: str = "") -> None:
    """One row of the audit table: job, state (running, completed, failed), details, at."""
    spark.createDataFrame([(job, state, details)], "job string, state string, details string").withColumn("at", F.current_timestamp()).write.mode("append").saveAsTable(table)


def run_job(spark: SparkSession, audit: str, job: str, body: Callable[[], object]) -> object:
    """Runs body between audit rows; a failure is recorded and raised."""
    record_job(spark, audit, job, "running")
    start = time.time()
    try:
        out = body()
    except Exception as e:
        record_job(spark, audit, job, "failed", f"{type(e).__name__}: {e}"[:500])
        raise
    record_job(spark, audit, job, "completed", f"{time.time() - start:.1f} s")
    return out


def register_files(spark: SparkSession, path: str, manifest: str) -> None:
    """Adds files not yet in the manifest (path, length, sha256)."""
    files = I.file_checksums(spark, path)
    if spark.catalog.tableExists(manifest):
        files = files.join(spark.table(manifest).select("path", "sha256"), ["path", "sha256"], "left_anti")
    files.write.mode("append").saveAsTable(manifest)


def ingest_csv(spark: SparkSession, path: str, facts: str, quarantine: str, mapping: dict[str, str] | None = None, behaviour: str = "split") -> dict[str, int]:
    """CSV to the fact table (first row per key wins, known keys stay) and the quarantine table; row counts of both."""
    raw = I.scan_csv(spark, path)
    raw = I.unpivot(raw)
    plan = M.resolve_mapping(raw.columns, mapping)
    M.check_mapping(plan, raw.columns)
    tagged = I.checked(I.apply_mapping(raw, plan))
    tagged.write.mode("overwrite").saveAsTable(f"{facts}_upload")  # arrival numbers are fixed here
    done = spark.table(f"{facts}_upload")
    good = I.split_entities(I.canonical(done.where("error_code is null")), behaviour)
    fresh = I.insert_new(spark.table(facts), good) if spark.catalog.tableExists(facts) else I.keep_first(good)
    before = spark.table(facts).count() if spark.catalog.tableExists(facts) else 0
    fresh.write.mode("append").saveAsTable(facts)
    bad = done.where("error_code is not null").drop("_ts", "_payload", "_metadata_ok")
    bad.write.mode("append").saveAsTable(quarantine)
    out = {"inserted": spark.table(facts).count() - before, "rejected": bad.count()}
    spark.sql(f"drop table {facts}_upload")
    return out


def ingest_sources(sources: dict[str, Callable[[], DataFrame]], facts: str) -> dict[str, str]:
    """Appends every source's rows; a source that fails is reported and leaves the others alone."""
    out = {}
    for name, load in sources.items():
        try:
            load().write.mode("append").saveAsTable(facts)
            out[name] = "ok"
        except Exception as e:  # isolated on purpose: the caller sees what failed
            out[name] = f"{type(e).__name__}: {e}"[:200]
    return out


def kpi_job(facts: DataFrame, business_type: str, table: str, digests: str) -> int:
    """KPI rows of entities whose facts changed, put in place of the table's; returns how many entities were computed.

    Only partitions (by entity) with changed entities are written again.
    """
    spark = facts.sparkSession
    fresh = A.dataset_hash(facts)
    known = spark.catalog.tableExists(digests)
    due = changed_entities(spark.table(digests), fresh) if known else fresh.select("entity")
    n = due.count()
    if n == 0:
        return 0
    months = star.monthly(facts.join(due, "entity", "left_semi"))
    rows = K.payload(K.compute(K.windows_of(months), business_type), business_type)
    U.merge(rows, table, ("entity",), U.by_entity())
    U.merge(fresh.join(due, "entity", "left_semi"), digests, ("entity",), U.by_entity())
    return n


def forecast_job(series: DataFrame, table: str) -> None:
    """Appends the next value of every series with its confidence, slope and last deviation."""
    line = S.linear_forecast(series, horizon=1).select("entity", "metric", "slope", "deviation")
    out = X.forecasts_or_fallback(series).join(line, ["entity", "metric"], "left")
    out.withColumn("created_at", F.current_timestamp()).write.mode("append").saveAsTable(table)


def latest_forecasts(table: DataFrame) -> DataFrame:
    """The newest forecast of each entity and metric."""
    return W.latest(table, ("entity", "metric"), ("created_at",))


def stored_risks(kpis: DataFrame, forecasts: DataFrame, churn: str = "churn_rate", primary: str = "recurring_revenue") -> DataFrame:
    """entity, risk_score, level, has_forecast from what is stored: the entity's newest KPI window and its newest forecast of the primary metric.

    kpis (entity, month, metric, value); forecasts (entity, metric, slope, deviation, acceleration if there is one,
    created_at). A KPI that the newest window lacks counts as 0.
    """
    newest = lambda name: F.coalesce(F.max(F.struct("month", F.when(F.col("metric") == name, F.col("value")).alias("v")))["v"], F.lit(0.0)).alias(name)
    own = kpis.groupBy("entity").agg(newest("growth_rate"), newest(churn))
    acceleration = "acceleration" if "acceleration" in forecasts.columns else F.lit(0.0).alias("acceleration")
    ahead = latest_forecasts(forecasts.where(F.col("metric") == primary)).select("entity", "slope", "deviation", acceleration, F.lit(True).alias("has_forecast"))
    met = own.join(ahead, "entity", "left").withColumn("has_forecast", F.coalesce("has_forecast", F.lit(False)))
    score = R.risk_score(F.col("growth_rate"), F.col(churn), F.col("slope"), F.col("deviation"), F.col("acceleration"), F.col("has_forecast"))
    return met.select("entity", score.alias("risk_score"), "has_forecast").withColumn("level", R.risk_level(F.col("risk_score")))


def risk_job(kpis: DataFrame, forecasts: DataFrame, table: str, business_type: str = "saas") -> None:
    """Appends the risk of every entity from its stored KPIs and forecast; an entity without a forecast fails the job."""
    out = stored_risks(kpis, forecasts, churn_metric(business_type))
    missing = [r["entity"] for r in out.where("not has_forecast").select("entity").limit(5).collect()]
    if missing:
        raise ValueError(f"no stored forecast of {', '.join(map(str, missing))}")
    out.drop("has_forecast").withColumn("created_at", F.current_timestamp()).write.mode("append").saveAsTable(table)


def export_kpis(maps: DataFrame, limit: int = 100_000) -> DataFrame:
    """The newest windows (entity, month, kpis), at most `limit` of them, then a row per metric.

    A window with an empty map gives one row of nulls; the limit counts windows,
    so there may be more rows than that.
    """
    head = maps.orderBy(F.desc("month"), "entity").limit(max(1, min(100_000, limit)))
    return head.select("entity", "month", F.explode_outer("kpis").alias("metric", "k")).select("entity", "month", "metric", "k.value", "k.unit", "k.is_valid", "k.error")


def export_rows(df: DataFrame, dataset: str, start: str | None = None, end: str | None = None, limit: int = 100_000, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Rows of one of the exportable datasets in a period, newest first."""
    if dataset not in ("records", "kpis", "forecasts", "risk"):
        raise I.IngestError("dataset", dataset)
    rows = df if start is None else df.where(F.col(ts) >= start)
    rows = rows if end is None else rows.where(F.col(ts) <= end)
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(max(1, min(100_000, limit)))
