"""Gates, layers, integrity, guardrail and confidence against tables of cases and a plain version."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import confidence as G


def told(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_gate(spark):
    cases = {
        ("failed", 0.9): "block", (" Blocked", 0.9): "block", ("partial", 0.19): "isolate", ("success", 0.19): "degrade", ("success", 0.29): "degrade", ("success", 0.3): "pass",
        ("insufficient_data", 0.9): "degrade", ("insufficient_data", 0.1): "isolate", ("partial", 0.2): "degrade", ("partial", 0.9): "pass", (None, 0.1): "isolate", (None, 0.5): "pass",
    }
    assert told(spark, list(cases), "s string, c double", G.gate(F.col("s"), F.col("c"))) == list(cases.values())


def test_forecast_guardrail(spark):
    cases = [
        (("insufficient_data", 12, "robust", 0.9, 0.9, "low"), "status_not_ok"), ((None, 12, "robust", 0.9, 0.9, "low"), "status_not_ok"), (("ok", 5, "robust", 0.9, 0.9, "low"), "below_reliable_datapoint_threshold"),
        (("OK", 6, "minimal", 0.9, 0.9, "low"), "minimal_tier_rejected"), (("ok", 6, "robust", 0.29, 0.9, "low"), "poor_regression_fit"), (("ok", 6, "robust", None, 0.30, "low"), "accepted"),
        (("ok", 6, "robust", 0.3, 0.32, "normal"), "volatility_adjusted_low_confidence"), (("ok", 6, "robust", 0.3, 0.33, "normal"), "accepted"), (("ok", 6, "robust", 0.3, 0.53, "high"), "volatility_adjusted_low_confidence"),
        (("ok", 6, "robust", 0.3, 0.54, "high"), "accepted"), (("ok", 6, "robust", 0.3, 0.35, None), "volatility_adjusted_low_confidence"), (("ok", 6, "robust", 0.3, 0.36, "strange"), "accepted"), (("ok", 6, "robust", 0.3, None, "low"), "volatility_adjusted_low_confidence"),
    ]
    got = told(spark, [c for c, _ in cases], "s string, n int, t string, r double, c double, v string", G.forecast_guardrail(*map(F.col, "sntrcv")))
    assert got == [w for _, w in cases]


def test_engine_confidence(spark):
    cases = [
        ((0.8, 0.4, "ok", "low", False, 0.0), 0.65 * 0.8 + 0.35 * 0.4), ((0.8, 0.4, "ok", "high", False, 0.0), 0.8 * 0.8 + 0.2 * 0.4), ((0.8, None, "ok", "low", False, 0.0), 0.68), ((0.8, 0.4, "ok", None, True, 0.1), 0.75 * 0.8 + 0.25 * 0.4 - 0.2),
        ((0.8, None, "insufficient_data", "low", False, 0.0), 0.45), ((0.95, 0.9, "ok", "high", False, 0.0), 0.80), ((0.1, None, "ok", "low", True, 0.2), 0.0), ((1.0, 1.0, "ok", "low", False, 0.0), 0.99), ((None, 0.5, "ok", "normal", False, 0.0), 0.175),
    ]
    got = told(spark, [c for c, _ in cases], "s double, f double, st string, v string, a boolean, c double", G.engine_confidence(F.col("s"), F.col("f"), F.col("st"), F.col("v"), F.col("a"), F.col("c")))
    assert got == pytest.approx([w for _, w in cases])


def test_layers(spark):
    sat = lambda n: math.log(n) / math.log(n + 1)
    cases = [
        ((None, 9, 0.9, 0.5, 3, 1.0, 1.0), (0.0, "block", "missing")), (("failed", 9, 0.9, 0.5, 3, 1.0, 1.0), (0.0, "block", "failed")), (("ok", 5, 0.9, 0.5, 3, 1.0, 1.0), (0.0, "degrade", "insufficient_data")),
        (("ok", 9, 0.05, 0.5, 3, 1.0, 1.0), (0.05, "isolate", "isolated_low_r2")), (("ok", 9, 0.4, 0.5, 3, 1.0, -1.0), (0.5, "isolate", "isolated_direction_conflict")), (("ok", 9, 0.5, 0.5, 3, 1.0, -1.0), (0.5, "pass", "success")),
        (("ok", 9, 0.2, None, 3, 1.0, 0.0), (sat(9) * 0.2 / (1 + math.log(4)), "degrade", "degraded_low_r2")), (("ok", 9, None, None, None, None, None), (sat(9) / (1 + math.log(4)), "pass", "success")),
    ]
    got = told(spark, [c for c, _ in cases], "s string, n int, r double, c double, h int, b double, g double", G.forecast_layer(*map(F.col, "snrchbg")))
    assert [(x["gate"], x["status"]) for x in got] == [w[1:] for _, w in cases] and [x["score"] for x in got] == pytest.approx([w[0] for _, w in cases])
    peers = [((1, 5, "local_db", 1.0), (0.0, "degrade")), ((4, 3, "local_db", 0.5), (math.sqrt(sat(4) * sat(3)) * 0.5, "pass")), ((4, 3, "External_Fetch", 1.0), (0.7 * math.sqrt(sat(4) * sat(3)), "pass")), ((4, 3, None, 1.0), (0.5 * math.sqrt(sat(4) * sat(3)), "pass"))]
    got = told(spark, [c for c, _ in peers], "p int, m int, s string, c double", G.competitive_layer(*map(F.col, "pmsc")))
    assert [x["gate"] for x in got] == [w[1] for _, w in peers] and [x["score"] for x in got] == pytest.approx([w[0] for _, w in peers])
    full = told(spark, [(7, 0, 0), (0, 30, 2), (0, 0, 5)], "r int, s int, n int", G.competitive_completeness(F.col("r"), F.col("s"), F.col("n")))
    assert full == pytest.approx([math.log(8) / math.log(9), math.sqrt(math.log(31) / math.log(55) * sat(3)), 0.0])


def plain_integrity(layers, missing):
    """The definition over a dict layer -> (score, gate)."""
    authority = {"kpi": 1.0, "cohort": 0.8, "segmentation": 0.6, "competitive": 0.5, "forecast": 0.4}
    used = {k: v for k, v in layers.items() if v[1] in ("pass", "degrade") and v[0] >= 0.01}
    w = {k: authority[k] / (2 if g == "degrade" else 1) for k, (_, g) in used.items()}
    score = sum(w[k] * used[k][0] for k in used) / sum(w.values()) if used else 0.0
    kpi = layers.get("kpi")
    if kpi and kpi[0] < 0.3:
        score *= (kpi[0] / 0.3) ** 2
    usable = layers.get("forecast", (0, "block"))[1] in ("pass", "degrade")
    caps = [0.35] * bool(kpi and kpi[1] == "degrade") + [0.30] * (not usable) + [0.25] * (len(used) < 3)
    score = min([score, *caps])
    quality = "blocked" if not used or kpi and kpi[0] == 0 else "partial_insight" if len(used) < 3 else "full_insight"
    return score * max(0.5, 1 - 0.15 * missing), len(used), usable, quality


def test_unified_integrity(spark):
    rnd = random.Random(9)
    cases, rows, lacking = {}, [], []
    for e in range(300):
        layers = {k: (rnd.choice([0.0, 0.005, 0.15, 0.29, 0.3, 0.6, 0.9, 1.0]), rnd.choice(["pass", "pass", "pass", "degrade", "isolate", "block"])) for k in G.AUTHORITY if rnd.random() < 0.8} or {"kpi": (0.5, "pass")}
        n = rnd.randrange(6)
        cases[f"e{e}"] = plain_integrity(layers, n)
        rows += [(f"e{e}", k, *v) for k, v in layers.items()]
        lacking += [(f"e{e}", n)] if n else []
    got = G.unified_integrity(spark.createDataFrame(rows, "entity string, layer string, score double, gate string"), spark.createDataFrame(lacking, "entity string, missing int")).collect()
    assert len(got) == 300 and {q for *_, q in cases.values()} == {"blocked", "partial_insight", "full_insight"}
    for r in got:
        assert (r["valid_layers"], r["forecast_usable"], r["quality"]) == cases[r["entity"]][1:]
        assert r["integrity"] == pytest.approx(cases[r["entity"]][0])


def test_audit_and_caps(spark):
    cases = [((0, 5, 1.0, 0.0), "blocked"), ((3, 0, 1.0, 0.0), "blocked"), ((3, 5, 0.0, 0.0), "blocked"), ((2, 5, 1.0, 0.0), "degraded"), ((3, 5, 0.4, 0.0), "degraded"), ((3, 5, 0.5, 1.1), "degraded"), ((3, 2, 0.5, None), "degraded"), ((3, 3, 0.5, 1.0), "pass")]
    assert told(spark, [c for c, _ in cases], "d int, l int, c double, s double", G.audit(*map(F.col, "dlcs"))) == [w for _, w in cases]
    caps = [((0.9, True, True, 4), 0.35), ((0.9, True, False, 4), 0.30), ((0.9, False, True, 2), 0.25), ((0.2, True, False, 1), 0.2), ((0.9, False, True, 3), 0.9)]
    assert told(spark, [c for c, _ in caps], "x double, k boolean, f boolean, n int", G.capped(*map(F.col, "xkfn"))) == [w for _, w in caps]
    blocks = [((1.0, 0.8, 1), True), ((0.9, 0.8, 1), False), ((1.5, 0.7, 2), False), ((0.3, 0.1, 3), True)]
    assert told(spark, [c for c, _ in blocks], "s double, w double, n int", G.blocking_conflicts(*map(F.col, "swn"))) == [w for _, w in blocks]


def test_insight_rows(series):
    got = {r["metric"]: r for r in G.insight_rows(series({"up": [100, 110], "down": [100, 100, 94], "flat": [10] * 12, "one": [5], "zero": [0, 3], "wild": [1, 9, 1, 9]})).collect()}
    assert {m: r["status"] for m, r in got.items()} == {"up": "growing", "down": "declining", "flat": "stable", "one": "unknown", "zero": "unknown", "wild": "growing"}
    assert got["flat"]["confidence"] == 1.0 and got["one"]["confidence"] == 0.1 and got["one"]["cv"] is None and got["up"]["trend"] is None
    assert got["wild"]["volatility"] == "high" and got["wild"]["cv"] == pytest.approx(0.8) and got["wild"]["confidence"] == pytest.approx(max(0.1, 4 / 12 - 0.24))
    assert got["down"]["trend"] == pytest.approx(-3 / 98) and got["down"]["volatility"] == "low"
