"""Batch jobs: ingestion to tables, incremental KPIs, audit rows, exports."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import contexts as X
from tallygrove.operators import kpis as K
from tallygrove.operators import scoring as R
from tallygrove.plans import jobs
from tallygrove.sources import ingest as I
from tallygrove.sources import star


@pytest.fixture
def db(spark, tmp_path):
    spark.sql(f"create database jobs_test location '{tmp_path}/db'")
    yield "jobs_test"
    spark.sql("drop database jobs_test cascade")


def test_ingest_csv_twice(spark, db, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("source,entity,category,metric,value,date\napi,a,saas,mrr,1,2024-01-01\napi,a,saas,mrr,2,2024-01-01\napi,b,saas,mrr,3,2024-01-01\napi,b,saas,mrr,4,never\n")
    facts, bad = f"{db}.facts", f"{db}.bad"
    assert jobs.ingest_csv(spark, str(p), facts, bad) == {"inserted": 2, "rejected": 1}
    assert jobs.ingest_csv(spark, str(p), facts, bad)["inserted"] == 0
    assert sorted(r["value"] for r in spark.table(facts).collect()) == [1.0, 3.0]
    with pytest.raises(I.IngestError, match="multiple_entities"):
        jobs.ingest_csv(spark, str(p), f"{db}.other", bad, behaviour="error")


def test_kpi_job_skips_unchanged(spark, db, sf_dir):
    f = star.facts(spark, sf_dir).where("entity in ('NATION_1', 'NATION_2')")
    n = f.select("entity").distinct().count()
    k, d = f"{db}.kpis", f"{db}.digests"
    assert jobs.kpi_job(f, "saas", k, d) == n
    first = spark.table(k).count()
    assert jobs.kpi_job(f, "saas", k, d) == 0
    changed = f.withColumn("value", F.when(F.col("entity") == "NATION_1", F.col("value") + 1).otherwise(F.col("value")))
    assert jobs.kpi_job(changed, "saas", k, d) == 1
    assert spark.table(k).count() == first


def test_forecast_and_risk_jobs(spark, db, sf_dir):
    s = star.series(star.monthly(star.facts(spark, sf_dir)))
    for _ in range(2):
        jobs.forecast_job(s, f"{db}.forecasts")
    stored = spark.table(f"{db}.forecasts")
    assert jobs.latest_forecasts(stored).count() == s.select("entity", "metric").distinct().count() == stored.count() // 2
    kpis = K.payload(K.compute(K.windows_of(star.monthly(star.facts(spark, sf_dir))), "saas"), "saas")
    jobs.risk_job(kpis, stored, f"{db}.risk")
    assert spark.table(f"{db}.risk").where("risk_score between 0 and 100").count() == s.select("entity").distinct().count()


def test_risks_from_what_is_stored(spark):
    day = datetime.date
    kpis = [("a", day(2024, 1, 1), "growth_rate", 0.9), ("a", day(2024, 2, 1), "growth_rate", -0.5), ("a", day(2024, 2, 1), "churn_rate", 0.4), ("b", day(2024, 1, 1), "growth_rate", 0.5), ("b", day(2024, 2, 1), "churn_rate", None), ("c", day(2024, 1, 1), "growth_rate", 0.0)]
    ahead = [("a", "recurring_revenue", 0.5, 0.1, 1), ("a", "recurring_revenue", -0.5, 0.2, 2), ("a", "other", -9.0, 9.0, 3), ("b", "recurring_revenue", 0.3, 0.0, 1)]
    k = spark.createDataFrame(kpis, "entity string, month date, metric string, value double")
    f = spark.createDataFrame(ahead, "entity string, metric string, slope double, deviation double, created_at int")
    got = {r["entity"]: (r["risk_score"], r["has_forecast"]) for r in jobs.stored_risks(k, f).collect()}
    score = lambda *x: spark.range(1).select(R.risk_score(*map(F.lit, x))).first()[0]
    assert got == {"a": (score(-0.5, 0.4, -0.5, 0.2, 0.0, True), True), "b": (score(0.0, 0.0, 0.3, 0.0, 0.0, True), True), "c": (score(0.0, 0.0, 0.0, 0.0, 0.0, False), False)}
    assert jobs.stored_risks(k, f.withColumn("acceleration", F.lit(1.0))).where("entity = 'a'").first()["risk_score"] == score(-0.5, 0.4, -0.5, 0.2, 1.0, True)
    with pytest.raises(ValueError, match="no stored forecast of c"):
        jobs.risk_job(k, f, "nowhere")


def test_audit_and_isolation(spark, db):
    audit = f"{db}.audit"
    assert jobs.run_job(spark, audit, "good", lambda: 7) == 7
    with pytest.raises(ZeroDivisionError):
        jobs.run_job(spark, audit, "bad", lambda: 1 / 0)
    assert sorted((r["job"], r["state"]) for r in spark.table(audit).collect()) == [("bad", "failed"), ("bad", "running"), ("good", "completed"), ("good", "running")]
    out = jobs.ingest_sources({"a": lambda: spark.range(3), "b": lambda: 1 / 0, "c": lambda: spark.range(2)}, f"{db}.all")
    assert out["a"] == out["c"] == "ok" and out["b"].startswith("ZeroDivisionError")
    assert spark.table(f"{db}.all").count() == 5


def test_register_files(spark, db, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.bin").write_bytes(n.encode())
    for _ in range(2):
        jobs.register_files(spark, f"{tmp_path}/*.bin", f"{db}.files")
    assert spark.table(f"{db}.files").count() == 2


def test_exports(spark):
    maps = spark.createDataFrame([("a", datetime.date(2024, 1, 1), {}), ("b", datetime.date(2024, 2, 1), {"x": (1.0, "value", True, None), "y": (None, "ratio", False, "bad")})], "entity string, month date, kpis map<string, struct<value: double, unit: string, is_valid: boolean, error: string>>")
    assert jobs.export_kpis(maps).count() == 3 and jobs.export_kpis(maps, 1).count() == 2
    with pytest.raises(I.IngestError):
        jobs.export_rows(maps, "everything")


def test_risk_with_snapshots(spark):
    """Nothing at all, cohorts only, growth standing in for a forecast, and a forecast met by growth and scenarios."""
    cols = "entity string, confidence double, forecast boolean, slope double, deviation double, acceleration double, revenue_delta double, churn_delta double, short_growth double, mid_growth double, long_growth double, trend_acceleration double, best_growth double, worst_growth double, cohort_acceleration double"
    rows = [
        ("none", 0.9, False, *[None] * 12),
        ("cohort", 0.5, False, *[None] * 11, 0.4),
        ("growth", 0.9, None, None, None, None, None, None, -0.4, -0.2, 0.1, -0.3, None, None, 0.1),
        ("full", 0.9, True, -0.6, 0.1, 0.0, 0.1, 0.2, -0.4, -0.2, 0.1, -0.3, 0.3, -0.5, 0.9),
    ]
    got = {r["entity"]: (r["source"], r["dimensions"], r["risk_score"], round(r["confidence"], 6)) for r in X.risk_with_snapshots(spark.createDataFrame(rows, cols)).collect()}
    assert got == {
        # Half of 25 points for growth and for churn, doubled without a forecast.
        "none": ("insufficient_data", 0, 50, 0.4),
        # 12.5 + 12.5 + 15 x 0.4 of acceleration.
        "cohort": ("cohort_proxy", 1, 31, 0.1),
        # 17.5 + 12.5 + 20 x 0.2 + 15 x 0.5 + 15 x 0.3.
        "growth": ("growth_cohort_proxy", 3, 46, 0.9),
        # 17.5 + 15 + 20 x 0.4 + 15 x 0.8 + 15 x 0.3.
        "full": ("forecast", 4, 57, 0.9),
    }


def test_data_quality(spark):
    parts = spark.createDataFrame([("e", "kpi", "success", 0.8), ("e", "risk", "failed", 0.7), ("e", "growth", "skipped", 0.6), ("e", "cohort", "insufficient_data", 0.5), ("f", "kpi", None, 0.4)], "entity string, component string, status string, confidence double")
    q = X.data_quality(parts)
    assert {(r["entity"], r["component"], r["state"], r["confidence"]) for r in q.collect()} == {
        ("e", "kpi", "available", 0.8), ("e", "risk", "unavailable", 0.0), ("e", "growth", "unavailable", 0.0), ("e", "cohort", "partial", 0.5), ("f", "kpi", "available", 0.4)}
    assert {r["entity"]: (r["components"], r["missing"]) for r in X.missing_components(q).collect()} == {"e": (4, ["growth", "risk"]), "f": (1, [])}


def test_macro_context_means(spark, series):
    s = series({"recurring_revenue": [1.0, 2.0, 3.0]}).withColumn("ts", F.add_months(F.lit("2024-01-31").cast("date"), F.col("seq")))
    inflation = spark.createDataFrame([(datetime.date(2023, 12, 31), 9.0), (datetime.date(2024, 1, 31), 1.0), (datetime.date(2024, 2, 29), 2.0), (datetime.date(2024, 5, 31), 9.0)], "period_end date, value double")
    r = X.macro_context(s, inflation, spark.createDataFrame([(2.0,)], "value double")).first()
    assert r["inflation"] == pytest.approx(1.5) and r["benchmark_gap"] == pytest.approx(0.5)
