"""How far the sources of a language differ in their terms.

Documents fall in groups (lang, source); null text, lang and source read as ''.
A term is a maximal run of ASCII letters and characters beyond ASCII, with A-Z
lower-cased. A language keeps its terms found in at least `LEAST_DOCS` of its
documents, V in all. A group, and the language itself, gives each kept term

    p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))

with N the sum of its counts. Two parts come out, both ranked within the group:

* `pair`: the distance sum(|p - q|) to every other source of the language;
* `term`: the TOP terms of the group with the largest p - q > 0, q the language's.

Terms. The terms of a group that have the same count share one p, so they form
a bucket, and the least and greatest q of a bucket bound what its terms can
reach. Buckets are taken best bound first: the first round takes as many as
surely hold TOP terms above the language, which gives a kth value; the second
round takes the others whose bound reaches it. Where a bound is strictly below
the kth value no term of the bucket is looked at.

Pairs. A term that a group lacks has a p that depends on the group alone (z).
With D over the terms both have,

    sum(|p - q|) = sum over a's terms |p - z_b| + sum over b's terms |q - z_a|
                 + (V - |a| - |b|) * |z_a - z_b| + D
    D = sum of |p - q| - |p - z_b| - |q - z_a| + |z_a - z_b|

The first three need a's and b's histograms of counts only. D comes from the
postings (the groups that have a term), in tiles of a block of groups by a block
of groups by some terms, so no pair of postings becomes a row. All sums are of
integers.

Defined cases: a language without kept terms has `pair` rows of value 0 and no
`term` rows; a language of one source has no `pair` rows; repeated rows count
each time; doc_id is not read, other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import broadcast_if_small, stored

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Groups on a side of a tile, and about so many terms in it.
GROUPS, TERMS = 256, 2_000
#: Counted terms a task holds before it hands them on.
HELD = 400_000
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences n and documents df of each term in each group, summed over what the task has read."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> Iterator[pd.DataFrame]:
        for (lang, source), (n, df) in ((g, c) for g, c in held.items() if c[0]):
            yield pd.DataFrame({"lang": lang, "source": source, "term": [t.decode("utf-8", "replace") for t in n], "n": list(n.values()), "df": [df[t] for t in n]})
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            found = _TERM.findall(text.encode("utf-8", "replace").lower())  # of bytes, so A-Z only
            n.update(found)
            df.update(set(found))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from handed_on()
    yield from handed_on()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term; decimals, so that no count overflows."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", top, (total + SMOOTH * kept).cast("decimal(22,0)")) + 1


def _model(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (lang, source, v, total, size, z) and postings (lang, source, term, n, p, z, q)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    read = docs.select(text("lang"), text("source"), text("text"))
    found = read.where("text <> ''").mapInPandas(_counted, "lang string, source string, term string, n long, df long")
    counts = stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("df").alias("df")).where(F.col("df") >= LEAST_DOCS)
    kept = stored(kept.select("lang", "term", "all_n"), "kept")
    own = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "own")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_total"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = groups.select("lang", "source", zero("v"), zero("lang_total"), zero("total"), zero("size"))
    z = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0)).cast("long")
    groups = stored(groups.withColumn("z", z), "groups")

    p = _share(F.col("n"), F.col("total"), F.col("v")).cast("long").alias("p")
    q = _share(F.col("all_n"), F.col("lang_total"), F.col("v")).cast("long").alias("q")
    postings = own.join(broadcast_if_small(groups), ["lang", "source"]).select("lang", "source", "term", "n", p, "z", q)
    return groups, stored(postings, "postings")


def top_terms(postings: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the `top` terms of each group by p - q, best bounds first."""
    group = ["lang", "source"]
    over = F.col("p") > F.col("q")
    buckets = (
        postings.groupBy(*group, "n")
        .agg((F.max("p") - F.min("q")).alias("bound"), F.count(F.when(over, 1)).alias("m"))
        .where("m > 0")
    )
    # Rows of a group here are its distinct counts, of which there are at most sqrt(2 N).
    best_first = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "n").rowsBetween(Window.unboundedPreceding, -1)
    buckets = stored(buckets.withColumn("first", F.coalesce(F.sum("m").over(best_first), F.lit(0)) < top), "buckets")
    value = (F.col("p") - F.col("q")).alias("value")
    ranked = Window.partitionBy(*group).orderBy(F.col("value").desc(), F.col("item").asc())
    terms = postings.where(over).select(*group, "n", F.col("term").alias("item"), value)

    def taken(chosen: DataFrame) -> DataFrame:
        return terms.join(broadcast_if_small(chosen.select(*group, "n")), [*group, "n"], "left_semi").select(*group, "item", "value")

    first = stored(taken(buckets.where("first")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).drop("rank"), "first")
    kth = first.groupBy(*group).agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("c"))
    rest = buckets.where("not first").join(kth, group).where((F.col("c") < top) | (F.col("bound") >= F.col("least")))
    return first.unionByName(taken(rest)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)


_PAIR = "lang string, a string, b string, value long"


def _sided(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of both blocks of a tile, and whether they are one block."""
    one = bool(pdf["bi"].iloc[0] == pdf["bj"].iloc[0])
    own = pdf["block"] == pdf["bi"]
    return pdf[own], pdf if one else pdf[~own], one


def _named(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray, value: np.ndarray, one: bool) -> pd.DataFrame:
    """Rows of the pairs with a value; each pair once, its lesser name first."""
    i, j = np.nonzero(np.less.outer(a, b) if one else np.ones(value.shape, dtype=bool))
    x, y = a[i], b[j]
    less = np.fromiter((p < q for p, q in zip(x, y, strict=True)), dtype=bool, count=len(x))
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": np.where(less, x, y), "b": np.where(less, y, x), "value": value[i, j]})


def _base_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """The part of each distance that the histograms give."""
    left, right, one = _sided(pdf)
    if not len(left) or not len(right):
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []}, dtype=object)

    def against(rows: pd.DataFrame, z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(z)), dtype=np.int64)
        for i, (p, m) in enumerate(zip(rows["ps"], rows["ms"], strict=True)):
            p, m = np.asarray(p, dtype=np.int64), np.asarray(m, dtype=np.int64)  # p ascending
            below_m, below = np.concatenate(([0], np.cumsum(m))), np.concatenate(([0], np.cumsum(m * p)))
            k = np.searchsorted(p, z)
            out[i] = z * below_m[k] - below[k] + (below[-1] - below[k]) - z * (below_m[-1] - below_m[k])
        return out

    za, zb = left["z"].to_numpy(), right["z"].to_numpy()
    absent = left["v"].iloc[0] - left["size"].to_numpy()[:, None] - right["size"].to_numpy()[None, :]
    value = against(left, zb) + against(right, za).T + absent * np.abs(za[:, None] - zb[None, :])
    return _named(pdf, left["source"].to_numpy(), right["source"].to_numpy(), value, one)


def _shared_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """D over the terms of the tile, posting list by posting list."""
    left, right, one = _sided(pdf)
    if not len(left) or not len(right):
        return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []}, dtype=object)
    (a, ai), (b, bi) = (np.unique(s["source"].to_numpy(dtype=object), return_inverse=True) for s in (left, right))
    value = np.zeros((len(a), len(b)), dtype=np.int64)
    lists = right.assign(i=bi).groupby("term").indices
    pa, za, pb, zb = (s[c].to_numpy()[:, None] if s is left else s[c].to_numpy()[None, :] for s in (left, right) for c in ("p", "z"))
    for term, x in left.groupby("term").indices.items():
        y = lists.get(term)
        if y is not None:
            p, z, q, w = pa[x], za[x], pb[:, y], zb[:, y]
            value[np.ix_(ai[x], bi[y])] += np.abs(p - q) - np.abs(p - w) - np.abs(q - z) + np.abs(z - w)
    return _named(pdf, a, b, value, one)


def _tiles(rows: DataFrame) -> DataFrame:
    """Each row once for every tile that its block meets; bi <= bj."""
    return (
        rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("bi", F.least("block", "o"))
        .withColumn("bj", F.greatest("block", "o"))
        .drop("o", "blocks")
    )


def source_distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of every source to every other one of its language."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUPS).cast("int").alias("blocks"), F.ceil(F.max("v") / TERMS).cast("int").alias("chunks"))
    sizes = stored(sizes, "sizes")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    by_count = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    # A list here holds a group's distinct counts, at most sqrt(2 N) of them.
    lists = by_count.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("h"))
    histograms = groups.join(lists, ["lang", "source"], "left").join(broadcast_if_small(sizes), "lang")
    none = F.array().cast("array<long>")
    histograms = histograms.select("lang", "source", "v", "size", "z", F.coalesce("h.p", none).alias("ps"), F.coalesce("h.m", none).alias("ms"), "blocks", block)
    base = _tiles(histograms).groupBy("lang", "bi", "bj").applyInPandas(_base_tile, _PAIR)

    chunk = F.pmod(F.xxhash64("term", F.lit(1)), F.col("chunks")).cast("int").alias("chunk")
    dealt = postings.join(broadcast_if_small(sizes), "lang").select("lang", "source", "term", "p", "z", "blocks", block, chunk)
    shared = _tiles(dealt).groupBy("lang", "chunk", "bi", "bj").applyInPandas(_shared_tile, _PAIR)

    pairs = stored(base.unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    there = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    back = pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    return there.unionByName(back)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of every group of docs."""
    groups, postings = _model(docs)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = source_distances(groups, postings).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    terms = top_terms(postings).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
