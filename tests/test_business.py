"""Formulas, joins, scores, scenarios and gates on small tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import columns as C
from tallygrove.operators import aggregates as A
from tallygrove.operators import confidence as G
from tallygrove.operators import joins as J
from tallygrove.operators import kpis as K
from tallygrove.operators import scenarios as N
from tallygrove.operators import scoring as R
from tallygrove.sources import macro
from tallygrove.sources.packs import PACKS, churn_metric, primary_metric

D = datetime.date


def one(spark, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))


@pytest.fixture
def inputs(spark):
    """Revenues 120 and 180, 100 customers, 5 lost, 240 before."""
    return one(spark, entity="e", month=D(2024, 1, 1), revenue=300.0, n_values=2, deviation=30.0, active=100.0, churned=5.0, previous=240.0)


@pytest.mark.parametrize(
    ("kind", "extra", "want"),
    [
        ("saas", {"gross_margin": 0.7}, {"mrr": 300, "churn_rate": 0.05, "ltv": 42.0, "growth_rate": 0.25}),
        ("saas", {}, {"ltv": 0.0}),
        ("financial_markets", {"risk_free_rate": 0.05}, {"market_revenue": 300, "account_churn": 0.05, "growth_rate": 0.25, "volatility": 30, "sharpe_like": 0.2 / 30}),
        ("ecommerce", {"total_visitors": 1000.0}, {"aov": 150, "conversion_rate": 0.002, "cac": None, "purchase_frequency": 0.02, "ltv": 3.0}),
        ("agency", {"average_client_lifespan_months": 10.0, "billable_hours": 80.0, "available_hours": 100.0}, {"client_ltv": 1500, "utilization_rate": 0.8, "revenue_per_employee": None}),
        ("healthcare", {"occupied_beds": 8.0, "total_beds": 10.0}, {"readmission_rate": 0.05, "bed_occupancy_rate": 0.8, "revenue_per_staff_hour": None}),
        ("marketing_analytics", {"ad_spend": 100.0, "clicks": 5.0, "impressions": 100.0}, {"roas": 3, "ctr": 0.05, "cac": 1}),
        ("operations", {"capacity_hours": 100.0, "downtime_hours": 10.0}, {"defect_rate": 0.05, "uptime_rate": 0.9, "productivity": None}),
        ("retail", {"cogs": 180.0, "orders_in": 3.0}, {"gross_margin_rate": 0.4, "average_ticket": 100, "conversion_rate": None}),
        ("general_timeseries", {"baseline_target": 600.0}, {"volatility": 30, "target_attainment": 0.5}),
    ],
)
def test_formulas(inputs, kind, extra, want):
    row = K.compute(inputs.withColumns({k: F.lit(v) for k, v in extra.items()}), kind).first()
    for k, v in want.items():
        assert row[k] == (pytest.approx(v) if v is not None else None), k


def test_zero_denominators_are_null(spark):
    z = one(spark, entity="e", month=D(2024, 1, 1), revenue=0.0, n_values=0, deviation=0.0, active=0.0, churned=0.0, previous=0.0)
    for kind in K.FORMULAS:
        K.compute(z, kind).collect()
    r = K.compute(z, "saas").first()
    assert r["churn_rate"] is None and r["growth_rate"] is None and r["ltv"] is None


def test_payload_errors(inputs):
    rows = {r["metric"]: (r["is_valid"], r["error"]) for r in K.payload(K.compute(inputs, "retail"), "retail").collect()}
    assert rows["net_sales"] == (True, None)
    assert rows["average_ticket"] == (False, "insufficient_data")


def test_packs():
    assert primary_metric("saas") == "mrr" and primary_metric("nothing") == "recurring_revenue"
    assert churn_metric("agency") == "client_churn"
    assert len(PACKS) == 9


def test_percent_rules(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (50.0,), (100.0,), (101.0,), (500.0,), (501.0,), (None,)], "v double")
    got = df.select(C.rate_open(F.col("v")).alias("a"), C.rate_closed(F.col("v")).alias("b"), C.rate_strict(F.col("v")).alias("c")).collect()
    assert [r["a"] for r in got] == [0.5, 1.0, 0.5, 1.0, 101.0, 500.0, 501.0, None]
    assert [r["b"] for r in got] == [0.5, 0.01, 0.5, 1.0, 1.01, 5.0, 501.0, None]
    assert [r["c"] for r in got] == [0.5, 1.0, 0.5, 1.0, None, None, None, None]


def test_asof_keeps_latest_start_even_if_it_ends(spark):
    left = spark.createDataFrame([(D(2024, 1, 15),), (D(2024, 2, 20),), (D(2023, 1, 1),)], "period_end date")
    right = spark.createDataFrame([(D(2024, 1, 1), D(2024, 12, 31), 1.0), (D(2024, 2, 1), D(2024, 2, 10), 2.0)], "period_start date, period_end date, value double")
    got = {r["period_end"]: r["value"] for r in macro.align(left, right).collect()}
    assert got == {D(2024, 1, 15): 1.0, D(2024, 2, 20): None, D(2023, 1, 1): None}
    filled = {r["value"] for r in macro.align_or(left, right, 9.0).collect()}
    assert filled == {1.0, 9.0}


def test_macro_transform(spark):
    raw = spark.createDataFrame(
        [("c", "m", D(2024, 2, 3), D(2024, 2, 3), "1.5"), ("c", "m", D(2024, 1, 1), D(2024, 12, 31), "2"), ("c", "m", D(2024, 3, 1), D(2024, 3, 31), "x"), ("c", "m", D(2024, 3, 9), D(2024, 3, 1), "1")],
        "country string, metric string, period_start date, period_end date, value string",
    )
    got = [(r["period_start"], r["error"]) for r in macro.transform_observations(raw, "M").collect()]
    assert got == [(D(2024, 2, 1), None), (D(2024, 1, 1), "frequency"), (D(2024, 3, 1), "value"), (D(2024, 3, 9), "bounds_reversed")]
    with pytest.raises(NotImplementedError):
        macro.provider(" IMF ")()
    with pytest.raises(ValueError):
        macro.provider("nowhere")


def test_inflation_adjusted(spark):
    df = spark.createDataFrame([("e", 0, 100.0, 100.0), ("e", 1, 110.0, None), ("e", 2, 121.0, 110.0)], "entity string, seq int, value double, cpi double")
    rows = macro.inflation_adjusted(df).orderBy("seq").collect()
    assert rows[2]["real_value"] == pytest.approx(110.0) and rows[2]["inflation"] == pytest.approx(0.1)
    assert rows[2]["real_growth"] == pytest.approx(0.0)


def test_peers_fall_back(spark):
    df = spark.createDataFrame([("a", 100.0), ("b", 90.0), ("c", 110.0), ("d", 120.0), ("z", 9000.0)], "e string, s double")
    got = {}
    for r in J.peers_by_size(df, "e", "s", least=3, most=10).orderBy("client", "place").collect():
        got.setdefault(r["client"], []).append(r["peer"])
    assert got["a"] == ["b", "c", "d"]
    assert got["z"] == ["a", "b", "c", "d"]


def test_conflicts(spark):
    df = spark.createDataFrame([("e", "revenue_growth_delta", 0.1), ("e", "Churn_Delta", 0.2), ("e", "conversion_delta", 0.0)], "entity string, signal string, value double")
    r = J.signal_conflicts(df).first()
    assert (r["rules_evaluated"], r["conflicts"], r["uncertain"]) == (3, 1, True)
    assert r["penalty"] == pytest.approx(0.108)


def test_risk(spark):
    df = one(spark, x=0.0)
    full = df.select(R.risk_score(F.lit(-1.0), F.lit(1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0), F.lit(True)).alias("a"), R.risk_score(F.lit(0.0), F.lit(0.0), F.lit(None), F.lit(None), F.lit(None), F.lit(False)).alias("b")).first()
    assert full["a"] == 100 and full["b"] == 50
    levels = [r[0] for r in spark.createDataFrame([(30,), (31,), (60,), (80,), (81,)], "s int").select(R.risk_level(F.col("s"))).collect()]
    assert levels == ["low", "moderate", "moderate", "high", "critical"]


def test_root_cause_order(spark):
    df = one(spark, entity="e", churn_delta=1.0, revenue_growth_delta=-1.0, cac_delta=1.0, ltv_delta=1.0, slope=1.0, deviation_percentage=0.0, risk_score=90)
    r = R.root_causes(df, "saas").first()
    assert r["issues"] == ["retention_issue", "acquisition_inefficiency", "high_business_risk"]
    assert r["primary_issue"] == "retention_issue" and r["severity"] == "critical"
    with pytest.raises(ValueError):
        R.root_causes(df, "unknown")


def test_segments_and_priority(spark):
    row = spark.range(1).select(
        R.segment_label(F.lit(0.2), F.lit(0.01), F.lit(0.1)).alias("a"), R.segment_label(F.lit(-0.1), F.lit(0.2), F.lit(0.1)).alias("b"),
        R.priority(F.lit("low"), F.lit("high"), F.lit(None).cast("string")).alias("c"), R.priority(F.lit("critical"), partial=F.lit(True)).alias("d"),
    ).first()
    assert tuple(row) == ("High Value / Growth Segment", "At Risk Segment", "high", "low")


def test_kmeans_separates(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10 + i * 0.01, 1.0) for i in range(40)], "id int, x double, y double")
    got = R.kmeans_segments(df, ("x", "y"), k=2, starts=2).groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("m")).collect()
    assert sorted(r["n"] for r in got) == [20, 20]


def test_kmeans_runs_on_as_many_parts_as_cores(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    parts, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, data: parts.append(data.rdd.getNumPartitions()) or fit(self, data))
    df = spark.range(400).repartition(40).select("id", (F.col("id") % 2 * 10.0).alias("x"), F.lit(1.0).alias("y"))
    got = R.kmeans_segments(df, ("x", "y"), k=2, starts=2).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [200, 200]
    assert len(parts) == 2 and max(parts) <= spark.sparkContext.defaultParallelism


def test_projection(spark):
    df = one(spark, client="c", last_value=100.0, last_date=D(2024, 11, 30), growth=0.1, industry=None, gdp=None).withColumns({"industry": F.lit(None).cast("double"), "gdp": F.lit(None).cast("double")})
    r = N.base_projection(df, 2).orderBy("quarter").collect()
    assert [x["revenue"] for x in r] == pytest.approx([110.0, 121.0])
    assert r[0]["period_end"] == D(2025, 2, 28)


def test_recovery_curves(spark):
    q = spark.range(1, 9).select(F.col("id").cast("int").alias("q"))
    u = [r[0] for r in q.select(N.recovery_multiplier(F.col("q"), F.lit(0.6), 2, "u_shape")).collect()]
    assert u == pytest.approx([1.0, 0.6, 0.6, 0.7, 0.8, 0.9, 1.0, 1.0])
    one_quarter = [r[0] for r in q.select(N.recovery_multiplier(F.col("q"), F.lit(0.6), 1, "v_shape")).collect()]
    assert one_quarter[:3] == pytest.approx([1.0, 0.8, 1.0])
    flat = [r[0] for r in q.select(N.recovery_multiplier(F.col("q"), F.lit(0.6), 0, "v_shape")).collect()]
    assert flat == [1.0] * 8


def test_erosion_raises_no_share(spark):
    df = one(spark, client="c", share=40.0, score=20.0, industry_growth=0.05, factor=0.1)
    r = N.erosion(df, 8, "severe").orderBy("quarter").collect()
    shares = [x["share"] for x in r]
    assert shares == sorted(shares, reverse=True) and shares[0] < 40
    assert N.erosion_impact(N.erosion(df, 8)).first()["impact_pct"] > 0


def test_dimension_shares_ignore_losses(spark):
    df = spark.createDataFrame([("d", "a", 30.0), ("d", "b", 10.0), ("d", "c", -5.0)], "dimension string, name string, total double")
    got = {r["name"]: (r["share"], r["place"]) for r in A.with_shares(df, ["dimension"]).collect()}
    assert got == {"a": (0.75, 1), "b": (0.25, 2), "c": (0.0, 3)}
    h = A.concentration(A.with_shares(df, ["dimension"])).first()
    assert h["hhi"] == pytest.approx(0.625) and h["effective_groups"] == pytest.approx(1.6)


def test_weighted_stats(spark):
    df = spark.createDataFrame([("k", 1.0, 0.2), ("k", 2.0, 0.2), ("k", 10.0, 0.6), ("k", 99.0, 0.0)], "k string, value double, weight double")
    r = A.weighted_stats(df, ["k"]).first()
    assert r["mean"] == pytest.approx(6.6) and r["median"] == 10.0 and r["n"] == 3


def test_dataset_hash_ignores_order(spark):
    rows = [("e", "m", float(i), datetime.datetime(2024, 1, 1)) for i in range(20)]
    schema = "entity string, metric string, value double, ts timestamp"
    a, b = (A.dataset_hash(spark.createDataFrame(r, schema)).first()["digest"] for r in (rows, rows[::-1]))
    c = A.dataset_hash(spark.createDataFrame(rows[1:], schema)).first()["digest"]
    assert a == b != c


def test_unit_economics_signals(spark):
    df = one(spark, entity="e", month=D(2024, 1, 1), ltv=50.0, cac=100.0, churn_rate=0.2, revenue=10.0, revenue_per_customer=1.0, growth_rate=0.1)
    r = K.unit_economics(df).first()
    assert r["signals"] == "acquisition_inefficiency,churn_crisis" and r["summary"] == "acquisition_inefficiency"
    assert r["confidence"] == pytest.approx(0.9 * 0.9)


def test_cohort_curves(spark):
    ts = lambda m, d=1: datetime.datetime(2024, m, d)
    rows = [(1, ts(1), "web", "s", 1), (2, ts(1, 2), "web", "s", 2), (1, ts(2), "web", "s", 3), (2, ts(3), "ad", "s", 4), (1, ts(3), "web", "s", 5)]
    f = spark.createDataFrame(rows, "customer int, ts timestamp, channel string, segment string, id int")
    c = A.cohort_activity(f, A.cohort_keys()).where("cohort_key = 'signup_month'").orderBy("seq").collect()
    assert [(r["active"], r["retention"]) for r in c] == [(2, 1.0), (1, 0.5), (2, 1.0)]
