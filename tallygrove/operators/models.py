"""Models of one's own: forecasts, risks and root causes by name, chosen row by row.

A forecast model is a function (positions, values, horizon) -> the next values;
it is fitted to each series in a grouped map, so it may be any Python code, and
a series that it cannot fit says so in `status` and leaves the others alone. A
risk model and a root-cause rule are column expressions over named signals:
what a row's name selects is a CASE, with no Python and no shuffle.

    register_forecast("seasonal", lambda seq, values, horizon: ...)
    forecasts(series.withColumn("model", ...))
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.operators.windows import KEYS

Forecast = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
Signals = Callable[[str], Column]


def _line(seq: np.ndarray, values: np.ndarray, horizon: int) -> np.ndarray:
    slope, intercept = np.polyfit(seq, values, 1)
    return intercept + slope * (seq[-1] + np.arange(1, horizon + 1))


def _drift(seq: np.ndarray, values: np.ndarray, horizon: int) -> np.ndarray:
    return values[-1] + np.arange(1, horizon + 1) * np.diff(values).mean()


#: Model by name: (function, least number of values).
FORECASTS: dict[str, tuple[Forecast, int]] = {"line": (_line, 3), "drift": (_drift, 2)}
RISKS: dict[str, Callable[[Signals], Column]] = {}
#: Rules by kind: (cause, condition over signals, severity).
CAUSES: dict[str, list[tuple[str, Callable[[Signals], Column], float]]] = {}


def register_forecast(name: str, model: Forecast, least: int = 2) -> None:
    FORECASTS[name] = (model, least)


def register_risk(name: str, model: Callable[[Signals], Column]) -> None:
    RISKS[name] = model


def register_causes(kind: str, rules: list[tuple[str, Callable[[Signals], Column], float]]) -> None:
    CAUSES[kind] = list(rules)


def forecasts(df: DataFrame, model: str = "model", horizon: int = 3, keys=KEYS) -> DataFrame:
    """keys, model, step, forecast, status of every series of df (keys, seq, value and a column that names the model).

    status is ok, insufficient_data, unknown_model or failed with what went wrong; without ok there is one row
    without step. A series' model is the one of its last row. A group is one series; null values are left out.
    """
    names, known = list(keys), dict(FORECASTS)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in names) + ", model string, step int, forecast double, status string"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        name = pdf["__model"].iloc[-1]
        x = pdf.dropna(subset=["value"])
        rows = []
        if name not in known:
            rows, status = [(None, None)], "unknown_model"
        elif len(x) < known[name][1]:
            rows, status = [(None, None)], "insufficient_data"
        else:
            try:
                ahead = np.asarray(known[name][0](x["seq"].to_numpy(dtype=float), x["value"].to_numpy(dtype=float), horizon), dtype=float)
                if ahead.shape != (horizon,) or not np.isfinite(ahead).all():
                    raise ValueError(f"{horizon} finite values expected")
                rows, status = list(enumerate(ahead, 1)), "ok"
            except Exception as e:  # a model of someone's own: the series says what went wrong
                rows, status = [(None, None)], f"failed: {type(e).__name__}: {e}"[:200]
        own = [pdf[k].iloc[0] for k in names]
        out = pd.DataFrame([(*own, name, step, value, status) for step, value in rows], columns=[*names, "model", "step", "forecast", "status"])
        return out.astype({"step": "Int32", "forecast": "float64"})

    return df.select(*names, "seq", F.col("value").cast("double").alias("value"), F.col(model).cast("string").alias("__model")).groupBy(*names).applyInPandas(fit, schema)


def _signals(df: DataFrame) -> Signals:
    have = set(df.columns)
    return lambda name: F.col(name).cast("double") if name in have else F.lit(None).cast("double")


def risks(df: DataFrame, model: str = "model") -> DataFrame:
    """df with risk, 0 to 100, by the model that each row names; null for an unknown one."""
    out = F.lit(None).cast("double")
    for name, f in RISKS.items():
        out = F.when(F.col(model) == name, f(_signals(df)).cast("double")).otherwise(out)
    return df.withColumn("risk", F.when(out.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), out))))


def root_causes(df: DataFrame, kind: str = "kind") -> DataFrame:
    """df with causes (cause, severity), gravest first, of the rules of each row's kind; empty where none holds."""
    x = _signals(df)
    held = [
        F.when((F.col(kind) == k) & F.coalesce(test(x), F.lit(False)), F.struct(F.lit(-float(severity)).alias("s"), F.lit(cause).alias("cause")))
        for k, rules in CAUSES.items() for cause, test, severity in rules
    ]
    found = F.array_sort(F.array_compact(F.array(*held))) if held else F.array().cast("array<struct<s:double,cause:string>>")
    return df.withColumn("causes", F.transform(found, lambda c: F.struct(c["cause"].alias("cause"), (-c["s"]).alias("severity"))))
