"""What is learned, against plain versions: the label model's rates and the linear model's optimum; awkward tables for the pipeline."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tallygrove.llm import quality_classifier as C
from tallygrove.llm import quality_rules as R
from tallygrove.llm.decontamination import contamination, decontaminate
from tallygrove.llm.language_id import fit, with_language
from tallygrove.llm.pii import redact
from tallygrove.llm.quality_rules import score_quality


def plain_label_model(rows, rounds=12):
    """The same estimate, text by text, in plain Python."""
    against = [sum(v == -1 for v in row) for row in rows]
    p = [0.95 if a == 0 else 0.1 if a == 1 else 0.02 for a in against]
    for _ in range(rounds):
        g, b = sum(p), len(p) - sum(p)
        held, lean = 1 + len(p) / 2, 1 + b / 10
        rates = {}
        for k, name in enumerate(R.RULES):
            for v in (1, 0, -1):
                a = sum(q for q, row in zip(p, rows, strict=True) if row[k] == v)
                c = sum(1 - q for q, row in zip(p, rows, strict=True) if row[k] == v)
                rates[name, v] = math.log((a + held * R.GOOD_VOTES[v]) / (g + held)) - math.log((c + lean * R.BAD_VOTES[v]) / (b + lean))
        prior = math.log((g + 1) / (b + 1))
        p = [1 / (1 + math.exp(-(prior + sum(rates[n, v] for n, v in zip(R.RULES, row, strict=True))))) for row in rows]
    return prior, rates, p


def test_label_model(spark):
    rnd = random.Random(3)
    right = (0.9, 0.85, 0.8, 0.7, 0.9, 0.6, 0.8, 0.75)
    truth = [rnd.random() < 0.75 for _ in range(400)]
    rows = [tuple(0 if rnd.random() < 0.15 else 1 if t or rnd.random() > q else -1 for q in right) for t in truth]
    model = R.fit_label_model(spark.createDataFrame(rows, ", ".join(f"{r} int" for r in R.RULES)))
    prior, rates, p = plain_label_model(rows)
    assert abs(model["prior"] - prior) < 1e-9 and all(abs(model["rates"][k] - v) < 1e-9 for k, v in rates.items())
    assert sum((q > 0.5) == t for q, t in zip(p, truth, strict=True)) > 0.95 * len(truth)


def test_linear_model_reaches_the_optimum(monkeypatch):
    """Coordinate descent against projected gradient steps on the whole dual."""
    monkeypatch.setattr(C, "DIM", 40)
    monkeypatch.setattr(C, "EPOCHS", 400)
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(40, size=8, replace=False)) for _ in range(60)]
    values = [v / np.linalg.norm(v) for v in rng.normal(size=(60, 8))]
    x = np.zeros((60, 41))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
    x[:, 40] = 1
    y = np.where(x[:, :40] @ rng.normal(size=40) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = C.dual_coordinate_descent(rows, values, y, np.full(60, C.COST))
    q, alpha = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, C.COST)
    best = (alpha * y) @ x
    loss = lambda w: 0.5 * w @ w + C.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    assert loss(w) <= loss(best) * (1 + 1e-6) + 1e-9 and np.abs(w - best).max() < 1e-3


def test_clashing_columns(spark):
    """Columns that are called as outputs or as helpers are kept, or replaced by the output."""
    data = [(d, f"Some plain words number {d} that go on for a while, said the {d} man. " * 4, "en") for d in range(12)] + [(99, None, None), (99, "", "de")]
    names = ("kept", "found", "items", "start", "end", "counts", "base", "added", "kind", "quality", "n_words", "length", "lang_pred", "score", "gram", "plane", "n", "e", "copy", "th", "key", "code")
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumns({c: F.lit("mine") for c in names})
    bench = spark.createDataFrame([(1, "completely different words in here that nobody wrote")], "item_id long, text string")
    assert decontaminate(df, bench).columns == df.columns and contamination(df, bench).count() == 14
    assert redact(df).columns == df.columns and redact(df).count() == 14
    assert score_quality(df).count() == 14
    out = with_language(df, fit(df))
    assert out.count() == 14 and Counter(r["lang_pred"] for r in out.collect()) == {"en": 12, "und": 2}


def test_pipeline_without_rows(spark, sf_dir, tmp_path):
    """An empty table of documents goes through all stages; so do documents without labels."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, docs, labels in (("none", source.limit(0), True), ("unlabelled", source.where("doc_id < 20"), False)):
        base = f"{tmp_path}/{name}"
        docs.write.parquet(f"{base}/documents.parquet")
        for t in ("labels", "benchmark"):
            x = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (x if labels or t != "labels" else x.limit(0)).write.parquet(f"{base}/{t}.parquet")
        out = P.run(spark, base)
        assert out.columns == [*source.columns, "shard", "slot"]
        assert (out.count() == 0) == (name == "none")
