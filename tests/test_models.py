"""Models of one's own, chosen per series or per row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import models as M


@pytest.fixture
def registry():
    kept = dict(M.FORECASTS), dict(M.RISKS), dict(M.CAUSES)
    yield
    for table, old in zip((M.FORECASTS, M.RISKS, M.CAUSES), kept, strict=True):
        table.clear()
        table.update(old)


def test_models_of_ones_own_over_one_frame(spark, registry):
    M.register_forecast("last", lambda seq, values, horizon: np.full(horizon, values[-1]))
    M.register_forecast("broken", lambda seq, values, horizon: 1 / 0)
    M.register_forecast("short", lambda seq, values, horizon: values[:1])
    models = {"a": "line", "b": "drift", "c": "last", "d": "broken", "e": "nobody", "f": "line", "g": None, "h": "short"}
    rows = [(e, "m", i, None if e == "f" and i else float(i * i), m) for e, m in models.items() for i in range(4)]
    got = {}
    for r in M.forecasts(spark.createDataFrame(rows, "entity string, metric string, seq int, value double, model string"), horizon=2).collect():
        got.setdefault((r["entity"], r["status"].split(":")[0]), []).append(r["forecast"])
    assert got["a", "ok"] == pytest.approx([11.0 - 3.0 + 3.0 - 0.0, 14.0]) and got["b", "ok"] == [12.0, 15.0] and got["c", "ok"] == [9.0, 9.0]
    assert {k for k in got if k[1] != "ok"} == {("d", "failed"), ("e", "unknown_model"), ("f", "insufficient_data"), ("g", "unknown_model"), ("h", "failed")}


def test_risks_and_causes_by_row(spark, registry):
    M.register_risk("churny", lambda x: 200 * x("churn"))
    M.register_risk("flat", lambda x: F.lit(40) - x("growth"))
    M.register_causes("saas", [("churn", lambda x: x("churn") > 0.1, 0.5), ("shrinking", lambda x: x("growth") < 0, 0.9), ("missing", lambda x: x("none") > 0, 1.0)])
    df = spark.createDataFrame([("a", "churny", "saas", 0.2, -1.0), ("b", "churny", "saas", 0.9, None), ("c", "flat", "other", 0.9, 5.0), ("d", "nobody", None, 0.0, 0.0)], "entity string, model string, kind string, churn double, growth double")
    got = {r["entity"]: (r["risk"], [c["cause"] for c in r["causes"]]) for r in M.root_causes(M.risks(df)).collect()}
    assert got == {"a": (40.0, ["shrinking", "churn"]), "b": (100.0, ["churn"]), "c": (35.0, []), "d": (None, [])}
