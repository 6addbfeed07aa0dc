"""Substring deduplication by sliding sentence spans.

A text is cut into sentences; a sentence of over `LONGEST` words is cut further
before the word whose hash (with the word before it) is least among any `WINDOW`
in a row. So a cut falls among any `WINDOW` words, and a passage is cut alike
wherever it stands but for `WINDOW` words at its ends: of 50 words in a row that
are repeated, a whole run is always inside. A character of a script written
without spaces is a word by itself and counts as half a one. A run
begins at every sentence and goes on for `RUN` sentences, and further until it
holds `LEAST_WORDS` words; each is hashed. A text too short for such a run is one
run as a whole, so it is compared with other whole texts. Run hashes are joined
over all documents, which gives the first document of each run; sentences
covered by a run that was in an earlier document, or earlier in the same one,
are removed.

Documents are ordered by doc_id (null last) and hash of the text. A task sorts
out the repeats within a document itself and hands on each of its hashes once.
Counting combines on the map side; the join back on the hash meets one row per
repeated run on the other side, so Spark can split a hot hash's rows.

Defined cases: null and empty texts have no sentences and are returned as they
are; runs must be equal in their words (ASCII case and white space aside); rows equal
in doc_id and text are one document and share one verdict; a repeat within one
document counts; texts that are removed whole stay as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm.common import broadcast_if_small, stored
from tallygrove.llm.text_hash import _BYTE, _SPACE, U, ascii_lower, mix, run_hashes, to_bytes, windows, word_bounds

RUN = 3
LEAST_WORDS = 12
LONGEST = 12
#: A long sentence is cut at least once among so many words.
WINDOW = 8
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_NEWLINE = 10
#: Bytes of text that are worked on together.
_TOGETHER = 1 << 19
_WIDE_STOPS = [np.frombuffer(c.encode(), dtype=np.uint8) for c in "\u3002\uff01\uff1f\uff0e\uff61"]


def _unspaced() -> np.ndarray:
    """By the first two bytes of a character: is its script written without spaces between words?"""
    table = np.zeros((256, 256), dtype=bool)
    table[0xE3:0xEA] = True  # CJK signs, kana, Han
    table[0xE0, 0xB8:] = True  # Thai, Lao, Tibetan
    table[0xE1, [0x80, 0x81, 0x82, 0x9E, 0x9F]] = True  # Burmese, Khmer
    table[0xE2, 0xBA:] = True  # radicals
    table[0xEF, [*range(0xA4, 0xAC), *range(0xBC, 0xBF)]] = True  # compatibility and wide forms
    table[0xF0, 0xA0:0xB4] = True  # rarer Han
    return table


_UNSPACED = _unspaced()


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, half words) of each word; a character of an unspaced script is a word and counts half."""
    first, end = word_bounds(data)
    if not len(first) or data.max() < 0xE0:
        return first, end, np.full(len(first), 2)
    alone = _UNSPACED[data, np.append(data[1:], np.uint8(0))]
    at = np.flatnonzero(alone)
    if not len(at):
        return first, end, np.full(len(first), 2)
    mark = np.zeros(len(data) + 1, dtype=bool)
    mark[first] = mark[at] = mark[np.minimum(at + np.where(data[at] >= 0xF0, 4, 3), len(data))] = True
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[end] = True
    # A mark on white space or at the end of the text is the end of a word already.
    mark &= ~edge
    begin = np.flatnonzero(mark)
    mark[first] = False
    return begin, np.flatnonzero(edge | mark), np.where(alone[begin], 1, 2)


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least (or equal to it) of some `width` in a row."""
    n = len(values) - width + 1
    if n < 1:
        return np.zeros(len(values), dtype=bool)
    least = values[:n]
    for j in range(1, width):
        least = np.minimum(least, values[j : j + n])
    padded = np.zeros(len(values) + width - 1, dtype=values.dtype)
    padded[width - 1 : width - 1 + n] = least
    most = padded[: len(values)]
    for j in range(1, width):
        most = np.maximum(most, padded[j : j + len(values)])
    return values == most


def sentences(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, half words, hash) of each sentence of a text's bytes; a sentence ends where the next begins.

    A sentence ends with a word that ends in a stop, or at a line's end; one of
    over LONGEST words is also cut at the least hashes of pairs of words.
    """
    first, end, half = tokens(data)
    n = len(first)
    if not n:
        return first, first, np.zeros(0, dtype=U)
    length = end - first
    low = ascii_lower(data)
    words = run_hashes(_BYTE[low[~_SPACE[low]]], np.cumsum(length) - length)
    last = data[end - 1]
    stop = _STOPS[last]
    for wide in _WIDE_STOPS if data.max() >= 0xE0 else ():
        at = np.flatnonzero((last == wide[2]) & (length > 2))
        stop[at] |= (data[end[at] - 2] == wide[1]) & (data[end[at] - 3] == wide[0])
    lines = np.cumsum(data == _NEWLINE)
    begins = np.ones(n, dtype=bool)
    begins[1:] = stop[:-1] | (lines[first[1:]] > lines[end[:-1] - 1])
    at = np.flatnonzero(begins)
    size = np.diff(at, append=n)
    if size.max() > LONGEST:
        # A sentence's begin is the least of any window it is in, so windows do not reach across it.
        pair = np.concatenate((np.zeros(1, dtype=U), windows(words, 2) | U(1)))
        pair[at] = 0
        begins |= np.repeat(size > LONGEST, size) & least_in_window(pair, WINDOW)
        at = np.flatnonzero(begins)
    start = first[at]
    start[0] = 0
    return start, np.add.reduceat(half, at), run_hashes(words, at)


class Runs:
    """The runs of several texts at once: texts are joined by line ends, which no sentence crosses.

    doc, first, last (byte, and end of the text's bytes): of each sentence; length:
    sentences of the run that begins at it, 0 where the text ends before the run is
    complete (if no run is complete, the whole text is one); hash: of that run;
    again: was the run in the same text before?
    """

    def __init__(self, texts: list[np.ndarray]):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.base = np.cumsum(size + 1) - size - 1
        self.data = np.full(int((size + 1).sum()), _NEWLINE, dtype=np.uint8)
        for t, at in zip(texts, self.base, strict=True):
            self.data[at : at + len(t)] = t
        self.first, words, hashes = sentences(self.data)
        n = len(self.first)
        self.doc = np.searchsorted(self.base, self.first, "right") - 1
        count = np.bincount(self.doc, minlength=len(texts))
        self.until = np.repeat(np.cumsum(count), count)
        self.first[np.cumsum(count)[count > 0] - count[count > 0]] = self.base[count > 0]
        total, begin = np.cumsum(np.concatenate(([0], words))), np.arange(n)
        end = np.maximum(begin + RUN, np.searchsorted(total, total[:-1] + 2 * LEAST_WORDS))
        self.length = np.where(end <= self.until, end - begin, 0)
        whole = np.flatnonzero((count > 0) & (np.bincount(self.doc, self.length, len(texts)) == 0))
        self.length[(np.cumsum(count) - count)[whole]] = count[whole]
        self.hash = np.zeros(n, dtype=U)
        for m in np.unique(self.length[self.length > 0]):  # a sentence has a word at least, so few lengths occur
            at = np.flatnonzero(self.length == m)
            run = np.zeros(len(at), dtype=U)
            with np.errstate(over="ignore"):
                for j in range(m):
                    run = run * U(0xD6E8FEB86659FD93) + hashes[at + j]
                self.hash[at] = mix(run + U(m)) | U(1)
        self.hash = self.hash.view(np.int64)
        # In the order of documents and hashes, the first of equal ones is the first in the text.
        self.order = np.lexsort((self.hash, self.doc))
        same = (self.doc[self.order][1:] == self.doc[self.order][:-1]) & (self.hash[self.order][1:] == self.hash[self.order][:-1])
        self.again = np.zeros(n, dtype=bool)
        self.again[self.order[1:]] = same
        self.again &= self.length > 0

    def distinct(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The hashes of each text, once each, and whether the text repeats a run of its own."""
        keep = self.order[(self.length > 0)[self.order] & ~self.again[self.order]]
        per_text = np.bincount(self.doc[keep], minlength=len(self.base))
        return np.split(self.hash[keep], np.cumsum(per_text)[:-1]), np.bincount(self.doc, self.again, len(self.base)) > 0

    def gone(self, repeated: list[np.ndarray | None]) -> list[list[tuple[int, int]]]:
        """Spans (code points) of each text that lie in its `repeated` runs or in runs it had before."""
        of = np.repeat(np.arange(len(repeated)), [0 if r is None else len(r) for r in repeated])
        known = [np.asarray(r, dtype=np.int64) for r in repeated if r is not None and len(r)]
        pair = lambda doc, h: mix(h.view(U) ^ mix(doc.astype(U)))
        marked = self.again.copy()
        if known:
            marked |= (self.length > 0) & np.isin(pair(self.doc, self.hash), pair(of, np.concatenate(known)))
        at = np.flatnonzero(marked)
        n = len(self.first)
        cover = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + self.length[at], minlength=n + 1))[:n] > 0
        edge = np.ones(n, dtype=bool)
        edge[1:] = (cover[1:] != cover[:-1]) | (self.doc[1:] != self.doc[:-1])
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        out: list[list[tuple[int, int]]] = [[] for _ in repeated]
        for i, j in zip(starts[cover[starts]], ends[cover[starts]], strict=True):
            d = self.doc[i]
            stop = self.first[j] if j < n and self.doc[j] == d else (self.base[d + 1] if d + 1 < len(self.base) else len(self.data)) - 1
            origin = points[self.base[d]]
            out[d].append((int(points[self.first[i]] - origin), int(points[stop] - origin)))
        return out


def in_chunks(texts: pd.Series) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts as bytes, some at a time, each time with the number of the first."""
    held, size, at = [], 0, 0
    for k, text in enumerate(texts):
        held.append(to_bytes(text))
        size += len(held[-1])
        if size >= _TOGETHER:
            yield at, held
            held, size, at = [], 0, k + 1
    if held:
        yield at, held


@F.pandas_udf(T.StructType().add("hashes", T.ArrayType(T.LongType())).add("again", T.BooleanType()))
def _runs(texts: pd.Series) -> pd.DataFrame:
    hashes, again = [], []
    for _, chunk in in_chunks(texts):
        h, a = Runs(chunk).distinct()
        hashes += h
        again += a.tolist()
    return pd.DataFrame({"hashes": pd.Series(hashes, dtype=object), "again": pd.Series(again, dtype=bool)})


_SPANS = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
_CUT = T.StructType().add("removed", _SPANS).add("text", T.StringType())


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    return "".join(kept) + text[at:]


@F.pandas_udf(_CUT)
def _cut(texts: pd.Series, repeated: pd.Series) -> pd.DataFrame:
    marked = np.flatnonzero([m is not None for m in repeated])
    removed, cut = [[] for _ in texts], texts.to_list()
    for at, chunk in in_chunks(texts.iloc[marked]):
        rows = marked[at : at + len(chunk)]
        for row, spans in zip(rows, Runs(chunk).gone([repeated.iloc[r] for r in rows]), strict=True):
            removed[row] = [{"start": s, "end": e} for s, e in spans]
            cut[row] = _without(cut[row], spans)
    return pd.DataFrame({"removed": pd.Series(removed, dtype=object), "text": pd.Series(cut, dtype=object)})


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, th and marks: hashes of the runs that an earlier document has.

    Documents with neither such a run nor one that they repeat themselves have no row.
    """
    runs = docs.select("doc_id", F.xxhash64("text").alias("th"), _runs("text").alias("r")).where("text is not null")
    runs = stored(runs.select("doc_id", "th", "r.*"), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    placed = runs.select("doc_id", "th", F.explode("hashes").alias("hash"))
    first = (
        placed.groupBy("hash")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("hash", F.col("first.doc_id").alias("__d"), F.col("first.th").alias("__t"))
    )
    first = broadcast_if_small(stored(first, "repeated"))
    own = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t"))
    later = placed.join(first, "hash").where(~own).groupBy("doc_id", "th").agg(F.collect_set("hash").alias("marks"))  # of one document's runs
    again = runs.where("again").select("doc_id", "th", F.array().cast("array<long>").alias("marks"))
    return stored(later.unionByName(again).groupBy("doc_id", "th").agg(F.flatten(F.collect_set("marks")).alias("marks")), "marks")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with cleaned text, n_removed (characters) and removed (spans in the old text)."""
    names = [c for c in docs.columns if c.lower() not in ("n_removed", "removed")]
    marks = repeated_runs(docs.select("doc_id", "text"))
    marks = marks.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "marks")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t"))
    cut = docs.select(*names).join(marks, same, "left").withColumn("__c", _cut("text", "marks"))
    length = F.aggregate("__c.removed", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return cut.select(
        *(F.col("__c.text").alias("text") if c == "text" else F.col(c) for c in names),
        length.cast("long").alias("n_removed"),
        F.col("__c.removed").alias("removed"),
    )


def repeats_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed and the cleaned text of every document."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_removed", "removed", "text")
