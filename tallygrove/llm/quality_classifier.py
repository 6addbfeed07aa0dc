"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed byte n-grams, word pairs and a few
shape bins. Class log-count ratios over all labelled training rows scale the
indicators; a linear hinge-loss model on the scaled, unit-length vectors is fit
by dual coordinate descent, and its margin is calibrated to a probability.

The ratios use every training row. The linear model is fit on a hash sample of
about `SAMPLE` rows a class (a bound that does not grow with the input).

Defined cases: null and empty texts have only shape features and get a score
like any other; labels without a text, or with a null quality, are not used;
several labels of one doc_id are averaged and rounded up; without training
rows of both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import broadcast_if_small, crc32_mod, stored, uniform
from tallygrove.llm.text_hash import U, mix, to_bytes, windows, word_hashes

DIM = 1 << 16
SAMPLE = 2500
EPOCHS = 12
COST = 1.0
THRESHOLD = 0.3
#: Most labels that are broadcast to the documents; beyond, the join shuffles.
LABEL_ROWS = 1_000_000
_BLOCK = 1 << 12


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers below DIM."""
    data = to_bytes(text)
    words = word_hashes(data)
    hit = np.zeros(DIM, dtype=bool)
    for width in (2, 3, 4):
        # Byte n-grams: the bytes themselves, packed, then hashed.
        n = len(data) - width + 1
        if n > 0:
            packed = np.full(n, width, dtype=U)
            for j in range(width):
                packed = (packed << U(8)) | data[j : j + n]
            hit[mix(packed) >> U(48)] = True
    pairs = windows(words, 2)
    hit[pairs >> U(48)] = True
    n = len(words)
    shape = [("length", int(np.log2(n + 1)))]
    if n > 1:
        shape += [("kinds", int(8 * len(np.unique(words)) / n)), ("pair kinds", int(8 * len(np.unique(pairs)) / (n - 1))), ("same", int(8 * np.mean(words[1:] == words[:-1])))]
    for name, level in shape:
        hit[int.from_bytes(f"{name}{level}".encode()[-7:], "little") * 40503 % DIM] = True
    return np.flatnonzero(hit)


def _scaled(index: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    value = ratio[index]
    return value / max(float(np.sqrt((value * value).sum())), 1e-9)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (last one: bias) of the hinge-loss model; visits rows in a fixed shuffled order."""
    w, alpha = np.zeros(DIM + 1), np.zeros(len(y))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            idx, val = rows[i], values[i]
            gradient = y[i] * (w[idx] @ val + w[DIM]) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # unit rows and a bias of 1: norm 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * val
                w[DIM] += step
                alpha[i] = new
    return w


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to probability, by Newton steps."""
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = weight * (p - y)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum()
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality) of the labelled documents that are not held out."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    one = one.where(crc32_mod(F.col("doc_id"), 5) != 0)
    return docs.select("doc_id", "text").where("text is not null").join(broadcast_if_small(one, LABEL_ROWS), "doc_id")


def _count_features(frames):
    """Per partition: documents of each class that have each feature, in blocks."""
    counts = np.zeros((2, DIM), dtype=np.int64)
    for pdf in frames:
        for text, label in zip(pdf["text"], pdf["quality"], strict=True):
            counts[label, features(text)] += 1
    if counts.any():
        yield pd.DataFrame(
            [{"label": c, "block": b, "counts": counts[c, b * _BLOCK : (b + 1) * _BLOCK]} for c in (0, 1) for b in range(DIM // _BLOCK)]
        )


def _add_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "block": [pdf["block"].iloc[0]], "counts": [np.sum(np.stack(pdf["counts"].to_list()), axis=0)]})


def log_count_ratios(train: DataFrame) -> np.ndarray:
    """One ratio a feature, from all training rows: log of its shares in the two classes."""
    schema = "label long, block long, counts array<long>"
    summed = train.select("text", "quality").mapInPandas(_count_features, schema).groupBy("label", "block").applyInPandas(_add_blocks, schema)
    counts = np.ones((2, DIM))
    for r in summed.collect():  # 32 rows of 4,096 numbers
        counts[r["label"], r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] += r["counts"]
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit(train: DataFrame) -> dict | None:
    """weights (with ratios folded in), bias, slope and offset; None if a class is missing."""
    sizes = {r[0]: r[1] for r in train.groupBy("quality").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    ratio = log_count_ratios(train)
    draw = F.when(F.col("quality") == 1, SAMPLE / sizes[1]).otherwise(SAMPLE / sizes[0])
    sample = train.where(uniform(F.lit(9), F.col("doc_id"), F.col("text")) < draw)

    def fit_sample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        rows = [features(t) for t in pdf["text"]]
        values = [_scaled(r, ratio) for r in rows]
        y = pdf["quality"].to_numpy()
        sign = np.where(y == 1, 1.0, -1.0)
        half = np.arange(len(y)) % 2 == 0
        present = [max(1, int((y == c).sum())) for c in (0, 1)]
        margin = np.zeros(len(y))
        for part in (half, ~half):  # margins for the calibration come from the half not fit on
            fit_on = np.flatnonzero(part)
            w = dual_coordinate_descent([rows[i] for i in fit_on], [values[i] for i in fit_on], sign[fit_on], np.full(len(fit_on), COST))
            for i in np.flatnonzero(~part):
                margin[i] = w[rows[i]] @ values[i] + w[DIM]
        weight = np.where(y == 1, sizes[1] / present[1], sizes[0] / present[0])
        a, b = calibrate(margin, y, weight / weight.mean())
        w = dual_coordinate_descent(rows, values, sign, np.full(len(y), COST))
        return pd.DataFrame({"weights": [(w[:DIM] * ratio).astype(np.float32).tobytes()], "bias": [w[DIM]], "slope": [a], "offset": [b]})

    model = sample.groupBy(F.lit(0).alias("__all")).applyInPandas(fit_sample, "weights binary, bias double, slope double, offset double").first()
    if model is None:
        return None
    return {"ratio": ratio.astype(np.float32), "weights": np.frombuffer(model[0], dtype=np.float32), "bias": model[1], "slope": model[2], "offset": model[3]}


def with_score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """docs with the probability that a text is good."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of DIM floats

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shipped.value
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            idx = features(text)
            r = m["ratio"][idx].astype(np.float64)
            out[i] = m["weights"][idx].astype(np.float64).sum() / max(float(np.sqrt(r @ r)), 1e-9) + m["bias"]
        return pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * out + m["offset"], -30, 30))))

    return docs.withColumn(name, score("text"))


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    return fit(stored(training_rows(docs, labels), "training"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select(
        "doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score reaches THRESHOLD."""
    return with_score(docs, learn(docs, labels), "__score").where(F.col("__score") >= THRESHOLD).select(*docs.columns)
