"""Likeness of names, the market's shares and survival means, by definition."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.functions.likeness import likeness, partial_ratio, ratio
from tallygrove.operators import confidence as G
from tallygrove.operators import scenarios as N
from tallygrove.operators import series as S


def longest_common(a, b):
    """Every subsequence of the shorter name, longest first."""
    a, b = sorted((a, b), key=len)
    for n in range(len(a), 0, -1):
        for part in itertools.combinations(a, n):
            it = iter(b)
            if all(c in it for c in part):
                return n
    return 0


def test_likeness_by_definition(spark):
    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("abc_") for _ in range(rnd.randrange(0, 9))) for _ in range(2)) for _ in range(150)]
    pairs = [tuple(p) for p in pairs] + [("churn_rate", "rate_of_churn"), ("mrr", "arr"), ("", ""), ("", "a"), ("é文", "文é")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(likeness(F.col("a"), F.col("b"))).collect()]
    for (a, b), x in zip(pairs, got, strict=True):
        want = 2 * longest_common(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert x == pytest.approx(want) and ratio(a, b) == pytest.approx(100 * want)


def test_partial_ratio():
    assert partial_ratio("value", "metricvalue") == 100.0 == partial_ratio("metricvalue", "value") and partial_ratio("", "") == 100.0 and partial_ratio("", "a") == 0.0
    assert partial_ratio("amount", "amt") == ratio("amt", "am") and partial_ratio("abcd", "xxab") == ratio("abcd", "ab")
    assert partial_ratio("abc", "cxx") == ratio("abc", "c")


def plain_market(revenue, rates, size, entrant, expansion):
    """Shares and ranks, quarter by quarter, for the base scenario."""
    whole = max(size, revenue[0]) or 1.0
    pool = max(0.0, whole - revenue[0])
    level = [pool / len(rates)] * len(rates) if rates else []
    out = []
    for q, own in enumerate(revenue):
        size *= 1 + expansion
        level = [x * (1 + r[q]) for x, r in zip(level, rates, strict=True)]
        new = entrant * size
        out.append((own / max(size, own + sum(level) + new), 1 + sum(x > own for x in level) + (new > own)))
    return out


def test_market_share_by_definition(spark):
    rnd = random.Random(2)
    clients, rivals, sizes, want = [], [], [], {}
    for c in range(12):
        revenue = [rnd.uniform(50, 150) for _ in range(5)]
        rates = [[rnd.uniform(-0.1, 0.2) for _ in range(5)] for _ in range(rnd.randrange(1, 4))]
        size = rnd.choice([0.0, 60.0, 400.0, 2000.0])
        clients += [(f"c{c}", q + 1, v) for q, v in enumerate(revenue)]
        rivals += [(f"c{c}", f"r{k}", q + 1, x) for k, r in enumerate(rates) for q, x in enumerate(r)]
        sizes.append((f"c{c}", size))
        want[f"c{c}"] = plain_market(revenue, rates, size, 0.2, 0.03), len(rates) + (size > 0)
    k = spark.createDataFrame(rivals, "client string, competitor string, quarter int, rate double")
    shares = N.market_share(spark.createDataFrame(clients, "client string, quarter int, revenue double"), k, spark.createDataFrame(sizes, "client string, industry double"), "base", 0.2, 0.03)
    for r in shares.collect():
        share, rank = want[r["client"]][0][r["quarter"] - 1]
        assert r["share"] == pytest.approx(share) and r["rank"] == rank
    for r in N.competitive_shift(shares, k).collect():
        x, n = want[r["client"]]
        assert r["share_delta"] == pytest.approx(100 * (x[-1][0] - x[0][0]))
        assert r["shift_index"] == pytest.approx(0.5 * (x[0][1] - x[-1][1]) / n + 0.5 * (x[-1][0] / x[0][0] - 1))


def test_restricted_mean(spark):
    df = spark.createDataFrame([("g", 1, True), ("g", 2, True), ("g", 2, False), ("g", 3, True), ("g", 5, False), ("h", 4, False)], "g string, duration int, observed boolean")
    got = {r["g"]: r["mean_survival"] for r in S.restricted_mean(df, ["g"]).collect()}
    # Levels 1, 0.8, 0.6, 0.3, 0.3 at 0, 1, 2, 3, 5.
    assert got["g"] == pytest.approx(0.9 + 0.7 + 0.45 + 0.6) and got["h"] == pytest.approx(4.0)


def test_signals_that_disagree(spark, series):
    s = series({"up": [10 + i for i in range(12)], "same": [10 + i for i in range(12)], "few": [1, 2]})
    signals = spark.createDataFrame([("e", "up", "a", 1.0), ("e", "up", "b", -1.0), ("e", "up", "c", -0.5), ("e", "up", "d", 0.0), ("e", "up", "x", None), ("e", "same", "a", -1.0), ("e", "few", "a", 1.0), ("e", "few", "b", -1.0)], "entity string, metric string, signal string, value double")
    got = {r["metric"]: r for r in G.series_confidence(s, signals=signals).collect()}
    assert got["up"]["pattern"] == "conflicting_indicators" and got["up"]["consistency"] == pytest.approx(0.7)
    assert got["same"]["pattern"].endswith("growth") and got["same"]["consistency"] == 1.0 and got["few"]["pattern"] == "insufficient_data"
    assert got["up"]["confidence"] == pytest.approx(got["same"]["confidence"] * 0.7**0.25)
