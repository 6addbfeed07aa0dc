"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at every position, one bit per language. An
n-gram belongs to a language if at least `LEAST_SHARE` of that language's
training texts have it; its positions then get the language's bit. One lookup
ANDs the masks at the n-gram's positions and so returns every language that has
the n-gram. Hits are counted per language, corrected for the share of n-grams
that an absent language would hit by chance, and the largest count decides.

N-grams are runs of 3 and 4 characters of the lower-cased text with each run of
other characters as one space, and whole words. The model is fit on at most
about `SAMPLE` texts a language; the n-grams of a language are at most
(n-grams of a text) / LEAST_SHARE, so the filter does not grow with the input.
Tasks fill the filter block by block of its positions.

Defined cases: null texts and texts without a letter are `und` with score 0; a
text that hits nothing gets the most frequent learned language with score 0;
without training rows all is `und`; ties go to the language that is first by
code point; repeated rows are predicted alike.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import broadcast_if_small, crc32_mod, stored, uniform
from tallygrove.llm.text_hash import U, mix, windows, word_hashes

SAMPLE = 4000
LEAST_SHARE = 0.01
POSITIONS = 1 << 21
HASHES = 3
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_BITS = 62
#: Positions of the filter that one task fills.
_BLOCK = 1 << 12
#: N-grams counted together in a task before their counts are handed on.
_AT_ONCE = 2_000_000


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    plain = _OTHER.sub(" ", f" {(text or '').lower()} ")
    points = np.frombuffer(plain.encode("utf-32-le", "replace"), dtype=np.uint32).astype(U)
    words = word_hashes(np.frombuffer(plain.encode("utf-8", "replace"), dtype=np.uint8))
    return np.unique(np.concatenate([windows(points, 3), windows(points, 4), mix(words)]))


def _positions(hashes: np.ndarray) -> list[np.ndarray]:
    """Positions of each hash: one array per hash function."""
    step = (hashes >> U(32)) | U(1)
    with np.errstate(over="ignore"):
        return [((hashes + U(i) * step) & U(POSITIONS - 1)).astype(np.intp) for i in range(HASHES)]


def training_rows(docs: DataFrame) -> DataFrame:
    """text and lang of the rows that are not held out, at most about SAMPLE a language. Texts are not shuffled."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(crc32_mod(F.col("doc_id"), 4) != 2)
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")), "langs")
    chosen = uniform(F.lit(4), F.col("doc_id"), F.col("text")) < F.lit(float(SAMPLE)) / F.col("__n")
    return rows.join(broadcast_if_small(sizes), "lang").where(chosen).select("lang", "text")


def _counted(lang: str, arrays: list[np.ndarray]) -> pd.DataFrame:
    found, n = np.unique(np.concatenate(arrays), return_counts=True)
    return pd.DataFrame({"lang": lang, "gram": found.view(np.int64), "n": n})


def _count_grams(frames):
    """Texts of each language that have each n-gram, in parts of about _AT_ONCE n-grams."""
    for pdf in frames:
        for lang, texts in pdf.groupby("lang")["text"]:
            arrays, held = [], 0
            for text in texts:
                arrays.append(grams(text))
                held += len(arrays[-1])
                if held >= _AT_ONCE:
                    yield _counted(lang, arrays)
                    arrays, held = [], 0
            if arrays:
                yield _counted(lang, arrays)


def _fill_block(pdf: pd.DataFrame) -> pd.DataFrame:
    masks = np.zeros(_BLOCK, dtype=np.int64)
    masks[pdf["at"].to_numpy() % _BLOCK] = pdf["mask"].to_numpy()
    return pd.DataFrame({"plane": [pdf["plane"].iloc[0]], "block": [pdf["block"].iloc[0]], "masks": [masks.tobytes()]})


def _filter_blocks(kept: DataFrame) -> DataFrame:
    """plane, block and masks of the filter from (plane, bit, gram)."""
    low = lambda c: c.bitwiseAND(POSITIONS - 1)
    first, step = low(F.col("gram")), low(F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1)))
    at = F.explode(F.array(*(low(first + i * step) for i in range(HASHES))))
    masks = kept.select("plane", "bit", at.alias("at")).groupBy("plane", "at").agg(F.bit_or("bit").alias("mask")).withColumn("block", F.floor(F.col("at") / _BLOCK).cast("int"))
    return masks.groupBy("plane", "block").applyInPandas(_fill_block, "plane int, block int, masks binary")


def fit(docs: DataFrame) -> dict | None:
    """The filter: languages, planes of masks and the chance of a false hit per language."""
    train = stored(training_rows(docs), "langtrain")
    sizes = stored(train.groupBy("lang").count(), "langs")
    counted = dict(sorted(map(tuple, sizes.collect())))  # one row a language
    if not counted:
        return None
    langs = list(counted)
    bits = [(i // _BITS, 1 << i % _BITS, name) for i, name in enumerate(langs)]
    numbers = train.sparkSession.createDataFrame(bits, "plane int, bit long, lang string").join(sizes, "lang")
    schema = "lang string, gram long, n long"
    kept = (
        train.repartition(max(8, train.rdd.getNumPartitions()))
        .mapInPandas(_count_grams, schema)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .join(broadcast_if_small(numbers), "lang")
        .where(F.col("n") >= F.ceil(LEAST_SHARE * F.col("count")))
        .select("plane", "bit", "gram")
    )
    planes = np.zeros((1 + (len(langs) - 1) // _BITS, POSITIONS), dtype=np.int64)
    for r in _filter_blocks(kept).toLocalIterator():  # POSITIONS longs for each 62 languages in all
        planes[r["plane"], r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["masks"], dtype=np.int64)
    filled = np.array([np.mean((planes[i // _BITS] >> np.int64(i % _BITS)) & 1) for i in range(len(langs))])
    common = max(counted, key=counted.get)
    return {"langs": langs, "planes": planes, "chance": filled**HASHES, "common": langs.index(common)}


def hits(model: dict, text: str | None) -> np.ndarray:
    """Corrected share of the text's n-grams that each language has."""
    g = grams(text)
    where = _positions(g)
    counts = np.zeros(len(model["langs"]))
    for plane, masks in enumerate(model["planes"]):
        mask = masks[where[0]]
        for p in where[1:]:
            mask = mask & masks[p]
        for i in range(min(_BITS, len(counts) - plane * _BITS)):
            counts[plane * _BITS + i] = ((mask >> np.int64(i)) & 1).sum()
    chance = model["chance"]
    return np.maximum(0.0, (counts / max(len(g), 1) - chance) / np.maximum(1 - chance, 1e-9))


def with_language(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred and score (the winner's share of all corrected hits)."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # POSITIONS longs for each 62 languages

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shipped.value
        rows = []
        for text in texts:
            if text is None or not _LETTER.search(text):
                rows.append((UNDETERMINED, 0.0))
                continue
            share = hits(m, text)
            best = int(share.argmax()) if share.any() else m["common"]
            rows.append((m["langs"][best], float(share[best] / share.sum()) if share.any() else 0.0))
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*names, predict("text").alias("__p")).select(*names, "__p.lang_pred", "__p.score")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    predicted = with_language(docs.select("doc_id", "text"), fit(docs))
    return predicted.select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
