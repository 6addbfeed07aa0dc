"""Canonical scans, signal deltas and category inference on small tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import inference as N
from tallygrove.sources import scans as C

T = datetime.datetime


@pytest.fixture
def facts(spark):
    rows = [
        (1, "csv", "a", "saas", "mrr", 10.0, T(2024, 1, 1), "r", None, '{"team": " red ", "size_band": "Small"}'),
        (2, "csv", "a", "saas", "mrr", None, T(2024, 1, 2), "r", None, None),
        (3, "csv", "b", "saas", "mrr", 5.0, T(2024, 1, 31), "r", None, '{"firm_size_band": "small", "channel": "web"}'),
        (4, "csv", "c", "saas", "mrr", 6.0, T(2024, 1, 15), "r", None, '{"size_band": "large", "acquisition_channel": ""}'),
        (5, "csv", "c", "retail", "mrr", 7.0, T(2024, 1, 15), "r", None, "not json"),
        (6, "csv", "de", "macro", "cpi", 1.0, T(2022, 6, 1), None, None, None),
        (7, "csv", "de", "macro", "cpi", 1.0, T(2020, 6, 1), None, None, None),
    ]
    return spark.createDataFrame(rows, "id int, source_type string, entity string, category string, metric string, value double, ts timestamp, role string, region string, metadata string")


def period():
    return (F.lit(T(2024, 1, d)) for d in (1, 31))


def test_dimension_scan_is_closed(facts):
    got = sorted((r["entity"], r["value"], r["team"]) for r in C.dimension_rows(facts, "saas", *period()).collect())
    assert got == [("a", 10.0, "red"), ("b", 5.0, None), ("c", 6.0, None)]
    assert {r["id"] for r in C.base_rows(facts, "saas", *period()).collect()} == {1, 2, 4}


def test_cohort_and_macro_scans(facts):
    got = {r["entity"]: r["acquisition_channel"] for r in C.cohort_rows(facts, "saas", *period()).collect()}
    assert got == {"a": None, "b": "web", "c": None}
    assert [r["id"] for r in C.macro_rows(facts, *period()).collect()] == [6]


def test_bands_and_peers(facts):
    assert {r["entity"]: r["band"] for r in C.entity_band(facts).collect()} == {"a": "small", "b": "small", "c": "large", "de": None}
    assert {r["entity"] for r in C.peer_rows(facts, "saas", "a", *period()).collect()} == {"b"}
    assert {r["entity"] for r in C.peer_rows(facts.where("id <> 3"), "saas", "a", *period()).collect()} == {"c"}
    assert {r["entity"] for r in C.peer_rows(facts, "saas", "nobody", *period()).collect()} == {"a", "b", "c"}


def test_signal_deltas(spark, series):
    s = series({"recurring_revenue": [10, 12], "churn_rate": [0.1, 0.05]})
    r = C.signal_deltas(s).first()
    assert r["revenue_growth_delta"] == pytest.approx(0.2) and r["churn_delta"] == pytest.approx(-0.5) and r["missing"] == 1
    direct = spark.createDataFrame([("e", "revenue_growth_delta", 0.7)], "entity string, signal string, value double")
    assert C.signal_deltas(s, direct).first()["revenue_growth_delta"] == 0.7


def test_trend_and_share(series):
    s = series({"mrr": [1, 2], "recurring_revenue": [3, 4]}).withColumn("ts", F.col("seq"))
    assert sorted(r["revenue"] for r in C.revenue_trend(s).collect()) == [3.0, 4.0]
    assert C.primary_metric_of(s, ()).first()["metric"] == "mrr"


def test_inference(spark):
    rows = [
        ("saas", ["MRR", "arr", "Churn Rate", "ltv", "cac"], ["month", "plan"], 500),
        ("shop", ["aov", "gmv", "orders", "cart_abandonment", "roas", "purchase_frequency"], ["order_id", "date"], 500),
        ("none", [], [], 0),
    ]
    d = spark.createDataFrame(rows, "dataset string, metrics array<string>, columns array<string>, rows long")
    best = {r["dataset"]: (r["category"], r["status"]) for r in N.infer(d).collect()}
    scores = N.category_scores(d)
    top = {r["dataset"]: r["c"] for r in scores.groupBy("dataset").agg(F.max_by("category", "score").alias("c")).collect()}
    assert top["saas"] == "saas" and top["shop"] == "ecommerce"
    assert best["none"][0] is None and best["none"][1] == "insufficient_data"
    assert scores.where("metric = 1 and dataset = 'saas' and category = 'saas'").count() == 1
