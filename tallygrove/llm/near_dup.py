"""Near-duplicate documents by fast similarity sketching.

A document's set is its distinct 5-word shingles. The sketch fills its bins in
rounds: round i drops every element into a hashed bin with value (i, hash), and
a second series of rounds sends all elements to one bin each, so every
coordinate is filled; each bin keeps its least value. Bands of coordinates
name candidates, and every link is confirmed on full sets.

Documents of equal sets are one node. In each bucket every node is compared
with a pivot, the node with the most company in all its buckets; links merge
nodes into components, and the round is repeated with another pivot where a
bucket still holds several components. What then lies across components is
compared in full: small buckets pair by pair, large ones in blocks of sets. So
a large bucket of copies costs one comparison per member, no pair of a large
bucket becomes a row, and no link between sets that share a bucket is lost.
With 32 bands of 4, a pair at similarity 0.75 shares no bucket with
probability 5e-6.

What a bucket's members are joined with (its size, its pivot) is written first,
so both sides of such a join are plain shuffles and Spark can split the rows of
a hot bucket.

Defined cases: a document with fewer than five words is one shingle, without
words its set is empty and it is linked with nothing (its component is its own
doc_id); doc_id may be null (component_id is then the smallest id of its
component, or null); rows equal in doc_id and text share one verdict.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm.common import BROADCAST_ROWS, broadcast_if_small, stored
from tallygrove.llm.text_hash import U, mix, seeds, shingles, windows

WIDTH = 5
PERCENT = 75
BINS, BAND_ROWS = 128, 4
#: Rounds of comparison with one pivot a bucket.
PIVOTS = 2
#: Members up to which a bucket's pairs become rows; beyond, they are compared in blocks.
SMALL = 16
BLOCK = 128
PAIRS_AT_ONCE = 4_000_000
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_SEEDS = seeds(2 * BINS, 101)


def fast_sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least (round, hash) of each bin; `bins` is a power of two, at most 128."""
    out = np.full(bins, _EMPTY, dtype=U)
    n, i = len(elements), 0
    while n and i < bins:
        some = min(max(1, 4096 // n), bins - i)  # rounds taken together; the least value wins in any order
        h = mix(elements[None, :] ^ _SEEDS[i : i + some, None])
        value = (h >> U(9)) | (np.arange(i, i + some, dtype=U)[:, None] << U(55))
        np.minimum.at(out, (h & U(bins - 1)).astype(np.intp).ravel(), value.ravel())
        i += some
        if (out != _EMPTY).all():
            return out
    for j in np.flatnonzero(out == _EMPTY) if n else ():
        out[j] = (mix(elements ^ _SEEDS[bins + j]) >> U(9)).min() | (U(bins + j) << U(55))
    return out


def _bands(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(-1, BAND_ROWS)
    out = np.arange(1, len(rows) + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for j in range(BAND_ROWS):
        out = mix(out ^ rows[:, j])
    return out.view(np.int64)


_SKETCH = T.StructType().add("n", T.LongType()).add("fp", T.BinaryType()).add("bands", T.ArrayType(T.LongType()))


@F.pandas_udf(_SKETCH)
def _sketch_udf(texts: pd.Series) -> pd.DataFrame:
    n, fp, bands = [], [], []
    for text in texts:
        s = shingles(text, WIDTH)
        n.append(len(s))
        fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        bands.append(_bands(fast_sketch(s)) if len(s) else None)
    return pd.DataFrame({"n": pd.Series(n, dtype="int64"), "fp": pd.Series(fp, dtype=object), "bands": pd.Series(bands, dtype=object)})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t, WIDTH).view(np.int64) for t in texts], dtype=object)


def _similar(a: Column, b: Column) -> Column:
    """Sizes alone allow a similarity of PERCENT."""
    return PERCENT * F.greatest(a, b) <= 100 * F.least(a, b)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the least node reachable.

    Least labels spread along links and labels then jump to their label's label,
    so rounds grow with the logarithm of a component's diameter.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("__m")).select("node", F.least("node", "__m").alias("comp")), "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("__n")).agg(F.min("comp").alias("__m"))
        step = stored(labels.join(near, F.col("node") == F.col("__n")).select("node", F.least("comp", "__m").alias("comp")), "step")
        up = step.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        labels = stored(step.join(up, F.col("comp") == F.col("__n"), "left").select("node", F.coalesce("__c", "comp").alias("comp")), "labels")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full sets of the nodes (node, doc_id, th); texts move only if the nodes are many."""
    few = nodes.count() <= BROADCAST_ROWS
    side = F.broadcast(nodes) if few else nodes
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = texts.join(side, texts["doc_id"].eqNullSafe(nodes["doc_id"]) & (texts["th"] == nodes["th"])).select("node", "text")
    return stored(found.select("node", _set_udf("text").alias("set")).dropDuplicates(["node"]), "sets")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, n, deg, comp of the buckets whose members are not all in one component yet."""
    known = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = stored(known, "known")
    apart = known.groupBy("key").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).where("__lo <> __hi").select("key")
    return stored(known.join(stored(apart, "apart"), "key", "left_semi"), "mixed")


def _pairs_within(members: DataFrame) -> DataFrame:
    """All pairs across components; for buckets of at most SMALL members."""
    other = members.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    across = (F.col("comp") < F.col("cb")) & _similar(F.col("n"), F.col("nb"))
    return members.join(other, "key").where(across).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set."""
    out = np.zeros(len(left) * len(right), dtype=np.int64)
    x, y = np.concatenate(left), np.concatenate(right)
    i, j = np.repeat(np.arange(len(left)), [len(v) for v in left]), np.repeat(np.arange(len(right)), [len(v) for v in right])
    order, back = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    x, i, y, j = x[order], i[order], y[back], j[back]
    lo, hi = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    count = hi - lo
    ends = np.cumsum(count)
    start = 0
    while start < len(x):  # at most about PAIRS_AT_ONCE matches in memory
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        c = count[start:stop]
        at = np.repeat(lo[start:stop] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        out += np.bincount(np.repeat(i[start:stop], c) * len(right) + j[at], minlength=len(out))
        start = stop
    return out.reshape(len(left), len(right))


def _links_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links across components between the minor and the other members of one pair of blocks."""
    sides = [pdf[pdf["minor"]], pdf[~pdf["minor"]]]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    left, right = ([np.asarray(v) for v in side["set"]] for side in sides)
    common = _common(left, right)
    total = np.array([len(v) for v in left])[:, None] + np.array([len(v) for v in right])[None, :] - common
    apart = sides[0]["comp"].to_numpy()[:, None] != sides[1]["comp"].to_numpy()[None, :]
    i, j = np.nonzero((100 * common >= PERCENT * total) & apart)
    a, b = sides[0]["node"].to_numpy()[i], sides[1]["node"].to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _links_by_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in large buckets, no pair left out and no pair made a row.

    A bucket's members outside its largest component (minor) meet all members,
    block by block; a block holds about BLOCK of each side.
    """
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("__m")).groupBy("key").agg(F.sum("__m").alias("__s"), F.max(F.struct("__m", "comp")).alias("__big"))
    sized = members.join(stored(sizes, "sizes"), "key").withColumn("minor", F.col("comp") != F.col("__big.comp"))
    all_blocks, minor_blocks = F.ceil(F.col("__s") / BLOCK), F.ceil((F.col("__s") - F.col("__big.__m")) / BLOCK)
    own = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), (blocks - 1).cast("int"))
    left = sized.where("minor").select("key", "node", "comp", "minor", own(minor_blocks).alias("mb"), F.explode(upto(all_blocks)).alias("ab"))
    right = sized.select("key", "node", "comp", F.lit(False).alias("minor"), F.explode(upto(minor_blocks)).alias("mb"), own(all_blocks).alias("ab"))
    shipped = left.unionByName(right).join(sets, "node")
    return shipped.groupBy("key", "mb", "ab").applyInPandas(_links_in_block, "a long, b long").distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, comp (null for an empty set) and component_id of every row of docs."""
    docs = docs.select("doc_id", "text")
    rows = stored(
        docs.select("doc_id", F.xxhash64("text").alias("th"), _sketch_udf("text").alias("s"))
        .select("doc_id", "th", "s.*")
        .withColumn("rid", F.monotonically_increasing_id()),
        "sketches",
    )
    full = rows.where("n > 0")
    classes = stored(full.groupBy("fp").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low")), "classes")
    reps = full.join(classes.select("node"), F.col("rid") == F.col("node"), "left_semi")
    buckets = reps.select(F.col("rid").alias("node"), "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    crowded = stored(buckets.join(stored(shared, "shared"), "key"), "buckets")
    degree = crowded.groupBy("node").agg(F.sum("__c").alias("deg"))
    live = stored(crowded.drop("__c").join(degree, "node").withColumn("comp", F.col("node")), "live")
    wanted = crowded.select("node").distinct()
    nodes = stored(full.join(wanted, F.col("rid") == F.col("node")).select("node", "doc_id", "th"), "nodes")
    sets = _sets(docs, nodes)

    links, labels = None, None
    for _ in range(PIVOTS):
        pivot = stored(live.groupBy("key").agg(F.max(F.struct("deg", "node", "n", "comp")).alias("p")), "pivots")
        members = live.join(pivot, "key").where("node <> p.node")
        apart = (F.col("comp") != F.col("p.comp")) & _similar(F.col("n"), F.col("p.n"))
        pairs = members.where(apart).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        found = _confirm(stored(pairs, "pairs"), sets)
        links = stored(found if links is None else links.union(found), "links")
        labels = components(links)
        live = _mixed(members.select("key", "node", "n", "deg"), labels)

    sizes = live.groupBy("key").agg((F.count(F.lit(1)) <= SMALL).alias("small"))
    rest = stored(live.join(stored(sizes, "sizes"), "key"), "rest")
    more = _confirm(_pairs_within(rest.where("small")), sets).union(_links_by_blocks(rest.where("not small"), sets))
    more = stored(more, "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    grouped = classes.join(labels, "node", "left").select("fp", "low", F.coalesce("comp", "node").alias("comp"))
    lowest = grouped.groupBy("comp").agg(F.min("low").alias("component_id"))
    answer = grouped.join(lowest, "comp").select("fp", "comp", "component_id")
    empty = rows.where("n = 0").select("doc_id", "th", "n", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return full.join(answer, "fp").select("doc_id", "th", "n", "comp", "component_id").union(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and kept of every row of docs."""
    return _grouped(docs).select(
        "doc_id", "th", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of the least doc_id (null last), then the least hash of the text.

    Rows without words are in no component and all stay.
    """
    rows = stored(_grouped(docs).where("comp is not null").select(F.col("doc_id").alias("__d"), F.col("th").alias("__th"), "comp"), "grouped")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("__d").isNull().alias("none"), "__d", "__th")).alias("best"))
    own = F.col("__d").eqNullSafe(F.col("best.__d")) & (F.col("__th") == F.col("best.__th"))
    dropped = stored(rows.join(stored(best, "best"), "comp").where(~own).select("__d", "__th").distinct(), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.xxhash64("text").eqNullSafe(F.col("__th"))
    left = docs.join(broadcast_if_small(dropped), same, "left_anti")
    again = stored(rows.groupBy("__d", "__th").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__d", "__th"), "again")
    if again.isEmpty():
        return left
    # Only rows that are there again, with the same doc_id and text, are grouped.
    again = broadcast_if_small(again)
    one = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same, "left_anti").unionByName(one)
