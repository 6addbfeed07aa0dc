"""Ranks and medians of groups against sorting, whatever the values."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import order as O
from tallygrove.operators import windows as W


def awkward():
    rnd = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.0, 1e-310, -1e-310, 1e300, -1e300, 2.0, 1.9999999999999998, 4.0, 3.9999999999999996, 1e-5, 5.0, 5.0, 5.0, None]
    rows = [(g, v) for g in ("a", None) for v in values]
    rows += [("b", rnd.choice((rnd.gauss(0, 1), float(rnd.randrange(4)), 1000 + rnd.random() / 1e6, rnd.random() * 10 ** rnd.randrange(-9, 9)))) for _ in range(400)]
    return rows + [("one", 7.0), ("none", None)]


def test_ranks_by_sorting(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "g string, value double")
    got = {(r["g"], r["value"]): (r["same"], r["below"], r["n"]) for r in O.value_ranks(df, ("g",)).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    want = {(g, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for g, vs in groups.items() for v in vs}
    assert got == want
    medians = {r["g"]: r["median"] for r in O.medians(O.value_ranks(df, ("g",)), ("g",)).collect()}
    assert medians == {g: pytest.approx(statistics.median(vs)) for g, vs in groups.items() if vs}
    ranked = O.with_ranks(df, ("g",))
    assert ranked.count() == len(rows) and ranked.where("value is null and __below is not null").count() == 0


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame(awkward(), "g string, value double")
    plan = O.value_ranks(df, ("g",))._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("__o" in x or "sum(__c#" in x for x in windows)  # of octaves, steps of an octave, values of a step


def test_global_rank(spark):
    values = [random.Random(k).choice((1.0, 2.5, -3.0, k / 7)) for k in range(60)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, value double")
    got = {r["k"]: r["rank"] for r in O.global_rank(df, F.col("value")).collect()}
    assert got == {k: 1 + sum(x > v for x in values) for k, v in enumerate(values)}


@pytest.mark.parametrize("higher", [True, False])
def test_competition_rank(spark, higher):
    rows = [("m", f"e{k}", v) for k, v in enumerate((3.0, 1.0, 3.0, 2.0, -5.0))] + [("n", "x", 1.0)]
    df = spark.createDataFrame(rows, "metric string, entity string, value double")
    got = {(r["metric"], r["entity"]): (r["rank"], r["n"], r["percentile"], r["field_median"]) for r in W.competition_rank(df, ["metric"], higher_is_better=higher).collect()}
    for m, e, v in rows:
        vs = [x for n, _, x in rows if n == m]
        rank = 1 + sum(x > v if higher else x < v for x in vs)
        assert got[m, e] == (rank, len(vs), 100.0 if len(vs) == 1 else (len(vs) - rank) / (len(vs) - 1) * 100, statistics.median(vs))
