"""Series operators against hand-computed numbers and plain Python."""

from __future__ import annotations

import math
import random
from statistics import mean, pstdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import series as S
from tallygrove.operators import windows as W


def values(df, column):
    return [r[column] for r in df.orderBy("seq").collect()]


def test_cagr_and_rolling(series):
    s = series({"m": [100, 110, 121, 133.1]})
    assert W.full_cagr(s).first()["cagr"] == pytest.approx(0.1)
    r = W.rolling(series({"m": [1, 100, 2, 3]}))
    assert values(r, "rolling_mean") == pytest.approx([1.0, 50.5, 34.333333, 35.0], abs=1e-6)
    assert values(r, "rolling_median") == pytest.approx([1.0, 50.5, 2.0, 3.0])
    g = W.rolling_growth(series({"m": [100, 110, 99, 108.9, 119.79]}))
    assert values(g, "rolling_growth")[-1] == pytest.approx(0.033333, abs=1e-6)


def test_growth_guards(series):
    g = W.growth(series({"m": [0, 1, 0]}))
    assert values(g, "level_growth") == [None, None, -1.0]
    assert values(g, "growth")[1] == pytest.approx(1e9)


def test_empty_and_single_series(series, spark):
    empty = spark.createDataFrame([], "entity string, metric string, seq int, value double")
    for op in (W.rolling, W.momentum, S.ols, S.cusum_shifts, S.holt_linear, S.binary_segmentation, S.spectral_peak, W.volatility_regime, S.granger):
        assert op(empty).count() == 0
    one = series({"m": [5]})
    assert S.ols(one).first()["slope"] == 0
    assert S.binary_segmentation(one).first()["changepoints"] == []
    assert S.cusum_shifts(one).first()["shifts"] == []


def test_constant_series(series):
    c = series({"a": [3] * 12, "b": [4] * 12})
    assert S.ols(c).collect()[0]["r_squared"] == 0
    assert {r["r"] for r in S.pearson_pairs(c).collect()} == {None}
    assert S.cross_correlation(c).count() == 0
    assert {r["acf"] for r in S.autocorrelation(c, [1]).collect()} == {0.0}


def py_cusum(xs, sigmas=4.0):
    m, s = mean(xs), pstdev(xs)
    out, run = [], 0.0
    if len(xs) < 8 or s <= 1e-9:
        return out
    for i in range(1, len(xs)):
        run += xs[i] - m
        if abs(run) >= sigmas * s:
            out.append(i)
            run = 0.0
    return out


def test_cusum(series):
    rnd = random.Random(3)
    data = {f"m{k}": [rnd.gauss(10, 1) + (4 if i > 14 and k % 2 else 0) for i in range(30)] for k in range(6)}
    got = {r["metric"]: r["shifts"] for r in S.cusum_shifts(series(data)).collect()}
    assert got == {k: py_cusum(v) for k, v in data.items()}


def py_holt(xs, grid=(0.2, 0.4, 0.6, 0.8)):
    best = None
    for a in grid:
        for b in grid:
            level, trend, sse = xs[0], xs[1] - xs[0], 0.0
            for x in xs[1:]:
                guess = level + trend
                sse += (x - guess) ** 2
                new = a * x + (1 - a) * guess
                trend = b * (new - level) + (1 - b) * trend
                level = new
            if best is None or sse < best[0]:
                best = (sse, a, b, level, trend)
    return best


def test_holt(series):
    xs = [10, 12, 15, 14, 18, 21, 20, 25]
    sse, a, b, level, trend = py_holt(xs)
    r = S.holt_linear(series({"m": xs})).first()
    assert (r["alpha"], r["beta"]) == (a, b)
    assert r["sse"] == pytest.approx(sse) and r["step_2"] == pytest.approx(level + 2 * trend)


def test_holt_winters_follows_a_season(series):
    xs = [10 + [0, 5, -5, 1][i % 4] + 0.5 * i for i in range(24)]
    r = S.holt_winters(series({"m": xs}), season=4).first()
    ahead = [10 + [0, 5, -5, 1][i % 4] + 0.5 * i for i in range(24, 27)]
    assert [r["step_1"], r["step_2"], r["step_3"]] == pytest.approx(ahead, abs=1.0)
    assert S.holt_winters(series({"m": xs[:7]}), season=4).count() == 0


def test_binary_segmentation_finds_steps(series):
    rnd = random.Random(1)
    xs = [rnd.gauss(0, 0.3) for _ in range(20)] + [rnd.gauss(6, 0.3) for _ in range(20)] + [rnd.gauss(-4, 0.3) for _ in range(20)]
    assert S.binary_segmentation(series({"m": xs})).first()["changepoints"] == [20, 40]


def error(x):
    return sum((v - sum(x) / len(x)) ** 2 for v in x) if x else 0.0


def plain_segmentation(x):
    """By definition: the best split of a part, then its left side, then its right."""
    found = []

    def cut(lo, hi):
        if len(found) >= 5 or hi - lo < 8 or error(x[lo:hi]) < 1e-9:
            return
        whole = error(x[lo:hi])
        best, at = max(((whole - error(x[lo:k]) - error(x[k:hi]) - 2 * math.log(hi - lo)) / whole, -k) for k in range(lo + 4, hi - 3))
        if best >= 0.15:
            found.append(-at)
            cut(lo, -at)
            cut(-at, hi)

    cut(0, len(x))
    return sorted(found)


def plain_cusum(x):
    m, up, down, hits = sum(x) / len(x), 0.0, 0.0, []
    sigma = math.sqrt(error(x) / len(x))
    for i in range(1, len(x)):
        up, down = max(0.0, up + x[i] - m), min(0.0, down + x[i] - m)
        if max(up, -down) > 4 * sigma:
            up = down = 0.0
            if not hits or i - hits[-1] >= 4:
                hits.append(i)
    return hits[:5] if len(x) >= 8 and sigma > 1e-9 else []


def stepped(rnd, n):
    """Small steps, a slope now and then, noise."""
    level, out, slope = 0.0, [], rnd.choice([0, 0, 0.05])
    for i in range(n):
        if rnd.random() < 0.12:
            level += rnd.choice([-1, 1]) * rnd.choice([0.5, 1, 2, 4])
        out.append(level + slope * i + rnd.gauss(0, 0.4))
    return out


def test_change_points_by_definition(series):
    rnd = random.Random(7)
    data = {f"m{k}": stepped(rnd, rnd.choice([6, 7, 8, 9, 15, 30, 60, 90])) for k in range(60)}
    df = series(data)
    b = {r["metric"]: r["changepoints"] for r in S.binary_segmentation(df).collect()}
    c = {r["metric"]: r["changepoints"] for r in S.two_sided_cusum(df).collect()}
    assert b == {m: plain_segmentation(x) for m, x in data.items()} and sum(len(x) == 5 for x in b.values()) >= 3
    assert c == {m: plain_cusum(x) for m, x in data.items()} and any(c.values())
    want = set()
    for m, x in data.items():
        kept = []
        for i in sorted({*b[m], *c[m]}):
            if not kept or i - kept[-1] >= 2:
                kept.append(i)
        for i in kept:
            near = [any(abs(i - j) <= 2 for j in found[m]) for found in (c, b)]
            left, right = x[max(0, i - 4) : i], x[i : i + 4]
            want.add((m, i, *near, all(near), round(sum(right) / len(right) - sum(left) / len(left), 6)))
    got = {(r["metric"], r["at"], r["cusum"], r["segmentation"], r["confirmed"], round(r["shift"], 6)) for r in S.changepoints(df).collect()}
    assert got == want and {g[4] for g in got} == {True, False}


def test_structural_break_by_definition(series):
    rnd = random.Random(8)
    data = {f"m{k}": [20 * v for v in stepped(rnd, rnd.choice([11, 12, 20, 40]))] for k in range(40)}
    got = {r["metric"]: r for r in S.structural_break(series(data)).collect()}
    for m, x in data.items():
        n = len(x)
        if n < 12:
            assert m not in got
            continue
        at = [i - (n - 1) / 2 for i in range(n)]
        slope = sum(a * v for a, v in zip(at, x, strict=True)) / sum(a * a for a in at)
        r = [v - sum(x) / n - slope * a for a, v in zip(at, x, strict=True)]
        sigma = math.sqrt(error(r) / n)
        mean = lambda part: sum(part) / len(part)
        score, cut = max((abs(mean(r[k:]) - mean(r[:k])) / sigma, -k) for k in range(6, n - 5))
        shift = abs(mean(x[-cut:]) - mean(x[:-cut]))
        assert (got[m]["break_at"], got[m]["is_break"]) == (-cut, score >= 0.95 and shift >= 5)
        assert got[m]["score"] == pytest.approx(score) and got[m]["shift"] == pytest.approx(shift)
    assert {r["is_break"] for r in got.values()} == {True, False}


def test_merge_nearby(spark):
    df = spark.createDataFrame([([1, 2, 6, 9, 10, 14],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(S.merge_nearby(F.col("x"), 4)).collect()] == [[1, 6, 10, 14], []]


def test_granger_direction(series):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=80)
    y = np.concatenate([[0, 0], 0.9 * x[:-2]]) + 0.1 * rnd.normal(size=80)
    r = {(a["cause"], a["effect"]): a for a in S.granger(series({"x": x, "y": y})).collect()}
    assert r["x", "y"]["f"] > 20 * r["y", "x"]["f"]


def test_cross_correlation_lag(series):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=60)
    y = np.roll(x, 2)
    got = S.cross_correlation(series({"a": x, "b": y})).first()
    assert abs(got["lag"]) == 2 and got["significant"]
    roles = {r["metric"]: r["role"] for r in S.lead_lag_roles(S.cross_correlation(series({"a": x, "b": y}))).collect()}
    assert roles["a"] == "leading" and roles["b"] == "lagging"


def test_spectral_and_seasonality(series):
    xs = [math.sin(2 * math.pi * i / 6) * 5 + 20 for i in range(36)]
    s = series({"m": xs})
    assert S.spectral_peak(s).first()["period"] == pytest.approx(6.0)
    found = {r["period"]: r["detected"] for r in S.detect_seasonality(s).collect()}
    assert found[6] and not found[4]


def test_structural_break(series):
    xs = [10.0] * 12 + [60.0] * 12
    r = S.structural_break(series({"m": xs})).first()
    assert r["break_at"] == 12
    assert S.structural_break(series({"m": xs[:8]})).count() == 0


def test_kaplan_meier(spark):
    df = spark.createDataFrame([("g", 1, True), ("g", 2, True), ("g", 2, False), ("g", 3, True), ("g", 5, False)], "g string, duration int, observed boolean")
    km = S.kaplan_meier(df, ["g"])
    got = [(r["duration"], r["at_risk"], round(r["survival"], 6)) for r in km.orderBy("duration").collect()]
    assert got == [(1, 5, 0.8), (2, 4, 0.6), (3, 2, 0.3)]
    assert S.median_survival(km, ["g"]).first()["median"] == 3


def test_retention_survival(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([0.9, 0.45, 0.45, 0.09])], "g string, seq int, retention double")
    r = S.retention_survival(df, ["g"]).orderBy("seq").collect()
    assert [round(x["survival"], 6) for x in r] == [1.0, 0.5, 0.5, 0.1]
    assert [round(x["hazard"], 6) for x in r] == [0.0, 0.5, 0.0, 0.8]
    assert [x["cumulative_hazard"] for x in r] == pytest.approx([0.0, math.log(2), math.log(2), math.log(10)])
    assert S.hazard_trend(S.retention_survival(df, ["g"]), ["g"]).first()["trend"] == "increasing"
    assert S.hazard_trend(S.retention_survival(df.where("seq < 3"), ["g"]), ["g"]).first()["trend"] == "insufficient_data"


def test_synthetic_retention(spark):
    got = spark.range(1).select(S.synthetic_retention(F.lit(0.5), 3).alias("x")).first()["x"]
    assert got == [1.0, 0.5, 0.25]


def test_ljung_box_white_and_trending(series):
    rnd = np.random.default_rng(2)
    s = series({"white": rnd.normal(size=60), "walk": np.cumsum(rnd.normal(size=60))})
    p = {r["metric"]: r["p_value"] for r in S.ljung_box(S.detrended(s)).collect()}
    assert p["walk"] < 0.01 < p["white"]


def test_compounding_restarts(series):
    s = series({"m": [1, 2, 3, 4, 5]}).withColumn("r", F.when(F.col("seq") != 2, F.lit(0.1)))
    assert values(W.compounded(s, "r"), "compounded") == pytest.approx([0.1, 0.21, None, 0.1, 0.21])


def test_spectral_peak_by_definition(series):
    """The transform gives what the sums over all frequencies give; of equal peaks the lowest counts."""
    import random

    rnd = random.Random(11)
    data = {f"m{k}": [rnd.gauss(0, 1) + 3 * math.sin(2 * math.pi * i / (3 + k)) for i in range(4 + 5 * k)] for k in range(12)}
    got = {r["metric"]: r for r in S.spectral_peak(series(data)).collect()}
    residuals = {}
    for r in S.detrended(series(data)).collect():
        residuals.setdefault(r["metric"], {})[r["seq"]] = r["residual"]
    for m, x in residuals.items():
        n = len(x)
        power = [abs(sum(v * complex(math.cos(2 * math.pi * k * i / n), math.sin(2 * math.pi * k * i / n)) for i, v in x.items())) ** 2 for k in range(1, n // 2 + 1)]
        assert got[m]["k"] == 1 + power.index(max(power)) and got[m]["power_share"] == pytest.approx(max(power) / sum(power))
    wave = np.array([math.cos(2 * math.pi * 2 * i / 16) + math.cos(2 * math.pi * 5 * i / 16) for i in range(16)])
    assert S.dominant_frequency(np.arange(16), wave) == (2, pytest.approx(0.5)) and S.dominant_frequency(np.arange(8), np.zeros(8)) == (1, 0.0)
    assert S.spectral_peak(series({"short": [1.0, 2.0, 3.0]})).count() == 0
