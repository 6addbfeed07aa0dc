"""Benchmark decontamination by the q-gram lemma.

A benchmark item is searched as segments of at most `SEGMENT` characters, and
as excerpts of `EXCERPT` characters at every `EXCERPT_STRIDE`, so an excerpt of
EXCERPT + EXCERPT_STRIDE - 1 characters (about 14 words) in a row is found
wherever it is taken from. An item under `MIN_ITEM` characters is searched whole,
between spaces (an edit may fall on one); one under `LEAST_ITEM` characters (a
word or a number) counts where it is a whole line, by equality. A segment of L characters that occurs in a text with at most k edits shares at
least L - q + 1 - k*q of its q-grams with it, all within k diagonals. Shared
q-grams are counted in overlapping diagonal bands; bands that reach the bound
are verified by an alignment restricted to the band. A document with a
verified segment is contaminated.

Defined cases: null and empty texts are clean; benchmark items that are null
or blank are not searched; repeated rows and items are each judged alone; an empty benchmark leaves every document clean.
Case and kinds of white space are ignored; positions are in the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import broadcast_if_small, stored
from tallygrove.llm.text_hash import U, windows

Q = 10
EDIT_SHARE = 0.08
SEGMENT, STRIDE = 160, 80
EXCERPT, EXCERPT_STRIDE = 72, 8
MIN_ITEM = 40
#: Items from here on have, with the spaces around them, a q-gram at least.
LEAST_ITEM = Q - 2
#: Characters of benchmark text that one block may hold; more are searched in blocks. A character is in up to 11 segments.
BLOCK_CHARS = 700_000
_BITS = 22


def _fold() -> np.ndarray:
    table = np.arange(0x3000, dtype=np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        table[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return table


_FOLD = _fold()


def folded(text: str | None) -> np.ndarray:
    """Code points, lower-cased, with white space as a space; as long as the text."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points)


def trimmed(text: str | None) -> np.ndarray:
    """An item's folded characters; a short one without white space around it."""
    points = folded(text)
    inner = folded((text or "").strip())
    return inner if len(inner) < MIN_ITEM else points


def _cut(item: np.ndarray, size: int, stride: int) -> list[tuple[int, np.ndarray]]:
    if len(item) <= size:
        return [(0, item)]
    starts = [*range(0, len(item) - size, stride), len(item) - size]
    return [(s, item[s : s + size]) for s in starts]


def segments(item: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(offset, characters): overlapping pieces of an item, long and short; a short item is one piece."""
    if len(item) < MIN_ITEM:
        return [(-1, np.concatenate(([32], item, [32])).astype(item.dtype))]
    return _cut(item, SEGMENT, STRIDE) + (_cut(item, EXCERPT, EXCERPT_STRIDE) if len(item) > EXCERPT else [])


def edit_budget(length: int) -> int:
    """Edits allowed in a segment; so many that it still shares a q-gram."""
    return max(0, min(int(EDIT_SHARE * length), (length - Q) // Q))


class QGramIndex:
    """The q-grams of a block of benchmark items, by hash."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.item, self.text = [], []
        grams, owner, at = [], [], []
        self.lines: dict[bytes, list] = {}
        for item_id, text in items:
            points = trimmed(text)
            if len(points) < LEAST_ITEM:
                self.lines.setdefault(points.tobytes(), []).append(item_id)
                continue
            for _, piece in segments(points):
                g = windows(piece.astype(U), Q)
                grams.append(g)
                owner.append(np.full(len(g), len(self.item)))
                at.append(np.arange(len(g)))
                self.item.append(item_id)
                self.text.append(piece)
        none = np.zeros(0, dtype=np.int64)
        grams, owner, at = (np.concatenate(x) if x else none for x in (grams, owner, at))
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.at = grams[order].astype(U), owner[order], at[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.grams >> U(64 - _BITS)] = True
        lengths = np.array([len(t) for t in self.text], dtype=np.int64)
        self.k = np.array([edit_budget(n) for n in lengths], dtype=np.int64)
        self.bound = np.maximum(1, lengths - Q + 1 - Q * self.k)

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(segment, first diagonal, last diagonal) of the bands that reach the bound."""
        g = windows(points.astype(U), Q)
        where = np.flatnonzero(self.seen[g >> U(64 - _BITS)])
        if not len(where):
            return []
        lo, hi = np.searchsorted(self.grams, g[where], "left"), np.searchsorted(self.grams, g[where], "right")
        count = hi - lo
        where, lo, count = where[count > 0], lo[count > 0], count[count > 0]
        if not len(where):
            return []
        pick = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        owner, diagonal = self.owner[pick], np.repeat(where, count) - self.at[pick]
        # Bands are 2(k+1) wide and overlap by half, so k+1 neighbouring diagonals lie within one.
        half = self.k[owner] + 1
        band = (diagonal + SEGMENT) // half
        keys = np.concatenate((owner * (1 << 40) + band, owner * (1 << 40) + np.maximum(band - 1, 0)))
        key, n = np.unique(keys, return_counts=True)
        seg, band = key >> 40, key & ((1 << 40) - 1)
        good = n >= self.bound[seg]
        return [(int(s), int(b * (self.k[s] + 1) - SEGMENT), int((b + 2) * (self.k[s] + 1) - SEGMENT - 1)) for s, b in zip(seg[good], band[good], strict=True)]

    def equal_lines(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """(item, start, end) of the lines that equal an item of under LEAST_ITEM characters."""
        at = 0
        for line in text.split("\n") if self.lines else ():
            inner = line.strip()
            if 0 < len(inner) < LEAST_ITEM:
                start = at + line.index(inner)
                for item in self.lines.get(folded(inner).tobytes(), ()):
                    yield item, start, start + len(inner)
            at += len(line) + 1

    def verified(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item, start, end) of the verified regions, merged per item."""
        found: dict = {}
        for item, start, end in self.equal_lines(text or ""):
            found.setdefault(item, []).append((start, end))
        points = folded(text)
        size = len(points)
        points = np.concatenate(([32], points, [32])).astype(points.dtype)  # words at a text's ends have spaces beside them too
        for s, first, last in self.regions(points):
            span = aligned(self.text[s], points, first, last, int(self.k[s]))
            if span:
                found.setdefault(self.item[s], []).append((max(0, span[0] - 1), min(size, span[1] - 1)))
        return [(i, min(a for a, _ in x), max(b for _, b in x)) for i, x in found.items()]


def aligned(piece: np.ndarray, points: np.ndarray, first: int, last: int, k: int) -> tuple[int, int] | None:
    """Where `piece` occurs in `points` with at most k edits, starting on a diagonal first..last."""
    n = len(piece)
    lo, hi = max(0, first - k), min(len(points), last + n + k + 1)
    for d in range(max(0, first), last + 1):
        if d + n <= len(points) and points[d] == piece[0] and np.array_equal(points[d : d + n], piece):
            return d, d + n
    # Row i of the table: cells on diagonals first-k .. last+k; a start costs nothing.
    width = last - first + 1 + 2 * k
    base = first - k
    row = np.zeros(width, dtype=np.int64)
    steps = np.arange(width)
    far = 1 << 30
    cols = base + steps
    row[(cols < 0) | (cols > len(points))] = far
    for i in range(1, n + 1):
        at = cols + i - 1  # text position that cell (i, column cols+i) consumes
        inside = (at >= 0) & (at < len(points))
        cost = np.where(inside, points[np.clip(at, 0, len(points) - 1)] != piece[i - 1], 1)
        new = np.where(inside, row + cost, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # piece character left out
        new = np.minimum.accumulate(new - steps) + steps  # text characters added
        row = new
        if row.min() > k:
            return None
    best = int(row.argmin())
    end = int(cols[best] + n)
    return (max(lo, end - n - k), min(hi, end)) if row[best] <= k else None


def _blocks(benchmark: DataFrame) -> Iterator[tuple[bool, list[tuple[int | None, str]]]]:
    """The benchmark in blocks of at most about BLOCK_CHARS characters (or one item), one at a time; and if it is the only one."""
    rows = benchmark.select("item_id", "text").where(F.regexp_like("text", F.lit(r"\S")))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = 1 + 2 * size // BLOCK_CHARS
    parts = rows.withColumn("__b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        yield n == 1, [(r[0], r[1]) for r in parts.where(F.col("__b") == b).orderBy("item_id", "text").collect()]


def _search(shipped):
    """A function from texts to the matches of one block of the benchmark."""

    @F.pandas_udf("array<struct<item_id:bigint,start:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        index = shipped.value
        return pd.Series([[{"item_id": i, "start": a, "end": b} for i, a, b in sorted(index.verified(t), key=str)] for t in texts], dtype=object)

    return found


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """docs with `name`: array of (item_id, start, end), empty for clean documents."""
    spark = docs.sparkSession
    none = F.array().cast("array<struct<item_id:bigint,start:int,end:int>>")
    hits = None
    for k, (only, block) in enumerate(_blocks(benchmark)):
        shipped = spark.sparkContext.broadcast(QGramIndex(block))  # at most about BLOCK_CHARS characters
        if only:
            return docs.withColumn(name, _search(shipped)("text"))
        found = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__t"), _search(shipped)("text").alias("__f"))
        found = stored(found.where(F.size("__f") > 0).select("__d", "__t", F.lit(k).alias("__k"), "__f"), "leaks")
        shipped.unpersist()
        hits = found if hits is None else hits.union(found)
    # Rows equal in doc_id and text have the same matches.
    pairs = F.array_sort(F.collect_set(F.struct("__k", "__f")))
    hits = stored(hits.groupBy("__d", "__t").agg(F.flatten(F.transform(pairs, lambda x: x["__f"])).alias("__f")), "leaks")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.xxhash64("text").eqNullSafe(F.col("__t"))
    joined = docs.join(broadcast_if_small(hits), same, "left").withColumn(name, F.coalesce("__f", none))
    return joined.drop("__d", "__t", *(["__f"] if name != "__f" else []))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, kept, n_items, items, starts and ends of every document."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, "found")
    return found.select(
        "doc_id",
        (F.size("found") == 0).alias("kept"),
        F.size("found").alias("n_items"),
        F.col("found.item_id").alias("items"),
        F.col("found.start").alias("starts"),
        F.col("found.end").alias("ends"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents."""
    return with_matches(docs, benchmark, "__found").where(F.size("__found") == 0).select(*docs.columns)
