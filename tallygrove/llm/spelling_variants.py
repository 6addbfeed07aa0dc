"""Groups of spelling variants: words one edit apart, found by range reporting in two dimensions.

A word's edit at position i leaves a prefix and a suffix as they are. Among the
words of one length, sorted forwards, those with the prefix are an interval;
sorted by their reversals, those with the suffix are another. A wavelet tree over
the reverse ranks in forward order reports the words that lie in both. A
replacement is looked up among words of the same length, an inserted code point
among words one longer (of a run of equal code points, at its first place), and
deletions are the same pairs from the other side.

The words are dealt out so that every such interval lies in one task: a word is
cut into pieces, and all edits within one piece leave the rest as it is, so words
meet by (length, piece, hash of the rest). A word is there once for each piece
and again, as the shorter partner, for each piece of the next length. A piece is
at most PIECE code points (more where a word has over PIECE * PIECES), so what
shares a rest is bounded by the alphabet, not by the data. Each task reports one
row a word: how many near words, and the best of them.

Defined cases: null and empty texts have no words; doc_id counts as its decimal
text, null as 'null'; repeated rows count each time; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import stored

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: One (document, run) in so many loses a code point.
SLIP = 199
PIECE, PIECES = 3, 8
#: Words of a length and piece that are put in one task, about.
SHARD = 20_000
#: Counted words a task holds before it hands them on.
HELD = 400_000
#: Queries that go down a wavelet tree together.
AT_ONCE = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _slipped(doc_id: str, run: str) -> str:
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()

    def handed_on() -> pd.DataFrame:
        out = pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})
        held.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            lower = text.encode("utf-8", "replace").lower().decode("utf-8")  # of bytes, so A-Z only
            for run, n in Counter(_RUN.findall(lower)).items():
                word = _slipped(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
        if len(held) > HELD:
            yield handed_on()
    yield handed_on()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs that are long and frequent enough."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id")
    found = docs.where("text <> ''").select(doc_id, "text").mapInPandas(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class WaveletTree:
    """Reports the values in [c, d) at the positions [a, b) of a permutation, for many such queries at once."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.before = [], []
        for bit in range(self.depth - 1, -1, -1):
            ones = (values >> bit) & 1
            before = np.concatenate(([0], np.cumsum(1 - ones)))  # zeros before each position
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, value) of everything found."""
        query, base = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
        for level in range(self.depth):
            half, before, zeros = 1 << (self.depth - 1 - level), self.before[level], self.zeros[level]
            za, zb = before[a], before[b]
            query, base = np.concatenate((query, query)), np.concatenate((base, base + half))
            a, b = np.concatenate((za, zeros + a - za)), np.concatenate((zb, zeros + b - zb))
            live = (a < b) & (base < d[query]) & (base + half > c[query])
            a, b, query, base = a[live], b[live], query[live], base[live]
        return query, base


class TwoWayIndex:
    """The words of one length, by prefix and by suffix."""

    def __init__(self, words: np.ndarray):
        self.length = words.dtype.itemsize
        self.order = np.argsort(words, kind="stable")
        self.forward = words[self.order]
        turned = words.view("S1").reshape(len(words), -1)[:, ::-1].copy().view(words.dtype).ravel()
        back = np.argsort(turned, kind="stable")
        self.backward = turned[back]
        rank = np.empty(len(words), dtype=np.int64)
        rank[back] = np.arange(len(words))
        self.back = back
        self.tree = WaveletTree(rank[self.order])

    @staticmethod
    def _interval(ordered: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size == 0:
            return np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(ordered), dtype=np.int64)
        ordered, starts = ordered.astype(f"S{size}"), starts.astype(f"S{size}")
        return np.searchsorted(ordered, starts, "left"), np.searchsorted(ordered, starts, "right")

    def around(self, words: np.ndarray, position: int, replaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number in words, number in the index) of the index's words with words[:position] before
        position and the rest of the word (without the code point there, if replaced) after it."""
        found = []
        suffix = self.length - 1 - position
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            turned = some.view("S1").reshape(len(some), -1)[:, ::-1].copy().view(some.dtype).ravel()
            a, b = self._interval(self.forward, some, position)
            c, d = self._interval(self.backward, turned, suffix)
            some_hit = np.flatnonzero((a < b) & (c < d))
            query, value = self.tree.report(a[some_hit], b[some_hit], c[some_hit], d[some_hit])
            found.append((some_hit[query] + at, self.back[value]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return (i[i != j], j[i != j]) if replaced else (i, j)


def _latin(words: pd.Series, length: int) -> np.ndarray:
    return np.array([w.encode("latin-1") for w in words], dtype=f"S{length}")


def _near_in_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per word of the shard: n_near (near words with the edit in this piece) and the best of them."""
    length, lo, hi = int(pdf["length"].iloc[0]), int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    rows_long, rows_short = np.flatnonzero(pdf["long"].to_numpy()), np.flatnonzero(~pdf["long"].to_numpy())
    sources, targets = [], []
    if len(rows_long):
        words = _latin(pdf["word"].iloc[rows_long], length)
        index = TwoWayIndex(words)
        letters = words.view("S1").reshape(len(words), -1)
        short = _latin(pdf["word"].iloc[rows_short], length - 1)
        for position in range(lo, hi):
            i, j = index.around(words, position, replaced=True)
            sources.append(rows_long[i])
            targets.append(rows_long[j])
            if len(short):
                i, j = index.around(short, position, replaced=False)
                if position:  # of a run of equal code points, the first place
                    first = letters[j, position] != letters[j, position - 1]
                    i, j = i[first], j[first]
                sources += [rows_short[i], rows_long[j]]
                targets += [rows_long[j], rows_short[i]]
    if not sources or not sum(len(x) for x in sources):
        return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}, dtype=object)
    pairs = pd.DataFrame({"s": np.concatenate(sources), "t": np.concatenate(targets)})
    words = pdf["word"].to_numpy(dtype=object)
    pairs["n"], pairs["near"] = pdf["n"].to_numpy()[pairs["t"]], words[pairs["t"]]
    pairs = pairs.sort_values(["s", "n", "near"], ascending=[True, False, True], kind="stable")
    best = pairs.groupby("s", sort=False).agg(n_near=("t", "size"), best_n=("n", "first"), best=("near", "first"))
    return pd.DataFrame({"word": words[best.index], "n_near": best["n_near"].to_numpy(), "best_n": best["best_n"].to_numpy(), "best": best["best"].to_numpy(dtype=object)})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of each word (word, n) with near words, their number and the most frequent."""
    size = F.length("word")
    roles = F.array(F.struct(size.alias("length"), F.lit(True).alias("long")), F.struct((size + 1).alias("length"), F.lit(False).alias("long")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*")
    rows = rows.withColumn("pieces", F.least(F.lit(PIECES), F.ceil(F.col("length") / PIECE)).cast("int"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = lambda k: F.floor(F.col("length") * k / F.col("pieces")).cast("int")
    rows = rows.withColumn("lo", cut(F.col("piece"))).withColumn("hi", cut(F.col("piece") + 1))
    own = F.col("hi") - F.col("lo") - F.when(F.col("long"), 0).otherwise(1)
    rest = F.xxhash64(F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.col("lo") + own + 1, F.length("word")))
    lengths = words.groupBy(size.alias("length")).agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    rows = rows.join(F.broadcast(lengths), "length")  # a row a length; without words of the length there is no partner
    shard = F.pmod(rest, F.col("shards")).cast("int").alias("shard")
    dealt = rows.select("word", "n", "length", "long", "piece", "lo", "hi", shard)
    found = dealt.groupBy("length", "piece", "shard").applyInPandas(_near_in_shard, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form); each round doubles the way followed.

    Forms grow in frequency by RATIO at each step, so ways are short and end.
    """
    forms = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = forms.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        step = stored(forms.join(on, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "roots")
        forms = step.drop("moved")
        if step.where("moved").isEmpty():
            return forms


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of docs."""
    words = stored(vocabulary(docs), "words")
    near = near_words(words)
    good = F.col("best_n") >= RATIO * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")
    )
    rows = stored(rows, "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
