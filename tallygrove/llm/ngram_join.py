"""Documents linked by the Jaccard similarity of their word shingles, exactly and without losing a link.

Documents of equal sets are one node. Shingles have one order for all documents:
rare before frequent (by hashed counters over the whole table, which decide the
order only), then by hash. Two sets that reach the similarity share a shingle
among the first n - ceil(PERCENT / 100 * n) + 1 of each, so nodes meet by such
shingles. What meets is divided by size: a band of sizes spans the ratio that the
similarity allows, so partners lie in one band or in two neighbours, and a tile
is a shingle and a band, with the next band's nodes as visitors.

A node carries a bitmap of about two bits a shingle; a shingle flips the bit of
its hash. Where the bitmaps of two sets differ in d bits, the sets differ in d
shingles at least, so common <= (na + nb - d) / 2. Pairs whose sizes or bitmaps rule out the
similarity go no further; the others are settled by the intersection of the
full sorted sets.

Where a tile's shingle is the first that two sets have in common, each has no more
in common with the other than its shingles from there on (its reach). Every pair
has such a tile, so a member leaves a large tile when its reach, or that of all members of
the sizes it could be linked with, is too short, or when they are of its own component. So near copies with
many shingles of their own do not stay in the tiles of what they all share.

Links merge nodes into components. In each tile the nodes are first compared with
one pivot, the node with most company in all its tiles, some rounds long; tiles
that are then of one component are done. Of the rest every two nodes of
different components are compared by bitmaps inside the task, block by block (a tile's
largest component as one side only), and only pairs that pass become rows. So a group of copies or near copies costs one
comparison a member, and no tile is held by one task.

Defined cases: a document with fewer than five words is one shingle, without
words its set is empty and it is linked with nothing (its component is its own
doc_id); doc_id may be null (component_id is then the smallest id of its
component, or null); repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrove.llm.common import BROADCAST_ROWS, broadcast_if_small, stored
from tallygrove.llm.near_dup import components
from tallygrove.llm.text_hash import U, shingles

WIDTH = 5
PERCENT = 80
#: Counters that the shingles of all documents are hashed to, and those summed in one row.
COUNTERS, CHUNK, SALTS = 1 << 21, 1 << 12, 64
#: Rows that a Python worker gets at a time.
BATCH = 1_000
#: Bits (a power of two) by which shingles of one row only are told apart from others before they are shuffled with their node.
KEY_BITS = 1 << 26
#: A shingle has two places among them; its bits from the second's last on are not told apart when rows are counted.
SECOND, TOLD_APART = 14, (1 << 40) - 1
#: Widths of bitmaps, in bytes.
LEAST_BITMAP, LARGEST_BITMAP = 8, 8192
#: Rounds of comparison with one pivot a tile.
PIVOTS = 3
#: Parts of a band of sizes for which a tile's members are summed up.
PARTS = 12
#: Members up to which a tile's pairs become rows; beyond, they are compared in blocks.
SMALL = 16
BLOCK = 512


def _packed(counts: np.ndarray) -> bytes:
    """Counters of a chunk in the narrowest type that holds them, compressed: most are small."""
    return zlib.compress(counts.astype(np.min_scalar_type(counts.max())).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, dtype=f"u{len(raw) // CHUNK}").astype(np.int64)


def _count_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The task's counters, in rows of CHUNK of them."""
    out = np.zeros(COUNTERS, dtype=np.int32)
    for batch in batches:
        for text in batch["text"]:
            np.add.at(out, (shingles(text, WIDTH) & U(COUNTERS - 1)).astype(np.intp), 1)
    rows = out.reshape(-1, CHUNK)
    used = np.flatnonzero(rows.any(axis=1))
    if len(used):
        yield pd.DataFrame({"chunk": used, "salt": TaskContext.get().partitionId() % SALTS, "counts": [_packed(rows[k]) for k in used]})


def _sum_counters(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, dtype=np.int64)
    for c in pdf["counts"]:
        total += _unpacked(c)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [_packed(total)]})


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """Twice the logarithm of each counter: COUNTERS bytes, whatever the table's size."""
    counted = docs.where("text is not null").select("text").mapInPandas(_count_shingles, "chunk long, salt int, counts binary")
    summed = counted.groupBy("chunk", "salt").applyInPandas(_sum_counters, "chunk long, counts binary")
    found = summed.groupBy("chunk").applyInPandas(_sum_counters, "chunk long, counts binary").toArrow()  # COUNTERS numbers
    total = np.zeros((COUNTERS // CHUNK, CHUNK), dtype=np.int64)
    for chunk, counts in zip(found["chunk"].to_pylist(), found["counts"].to_pylist(), strict=True):
        total[chunk] = _unpacked(counts)
    return (2 * np.log2(total.ravel() + 1)).astype(np.uint8)


def least_common(n: int) -> int:
    """Shingles that a set of n has in common with any set it is linked with, at least."""
    return -(-PERCENT * n // 100)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles by hash; the width is a power of two, so wide bitmaps fold onto narrow ones."""
    size = LEAST_BITMAP
    while size < LARGEST_BITMAP and 4 * size < len(s):
        size *= 2
    bits = np.bincount(((s >> U(21)) & U(8 * size - 1)).astype(np.intp), minlength=8 * size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(b: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) at a smaller width: the places that meet are added without carry."""
    return np.bitwise_xor.reduce(b.reshape(len(b), -1, size), axis=1)


def _may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes whose bitmaps differ in so many bits can reach the similarity."""
    total = na + nb
    common = np.minimum((total - differ) // 2, np.minimum(na, nb))
    return 100 * common >= PERCENT * (total - common)


_NODE = T.StructType().add("n", T.LongType()).add("fp", T.BinaryType()).add("bits", T.BinaryType()).add("first", T.ArrayType(T.LongType()))


def _describe(levels: np.ndarray):
    """An Arrow function from text to size, fingerprint, bitmap and first shingles."""

    @F.pandas_udf(_NODE)
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = {"n": [], "fp": [], "bits": [], "first": []}
        for text in texts:
            s = shingles(text, WIDTH)
            n = len(s)
            out["n"].append(n)
            out["fp"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
            out["bits"].append(bitmap(s) if n else None)
            order = np.argsort(levels[(s & U(COUNTERS - 1)).astype(np.intp)], kind="stable")  # s is sorted by hash
            out["first"].append(s[order[: n - least_common(n) + 1]].view(np.int64) if n else None)
        return pd.DataFrame({k: pd.Series(v, dtype="int64" if k == "n" else object) for k, v in out.items()})

    return describe


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """KEY_BITS bits, of which two for each of the keys are set: at most KEY_BITS / 64 rows come to the driver."""
    place = keys.select(F.explode(F.array("key", F.shiftright("key", SECOND))).alias("k")).select(F.pmod("k", F.lit(KEY_BITS)).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))
    found = words.toArrow()
    out = np.zeros(KEY_BITS // 64, dtype=np.int64)
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out.view(U)


def _kept_by(bits: np.ndarray):
    """An Arrow function from size and first shingles to those whose two bits are set, each with its reach."""

    def is_set(k: np.ndarray) -> np.ndarray:
        p = k & (KEY_BITS - 1)
        return (bits[p >> 6] >> (p & 63).astype(U)) & U(1)

    @F.pandas_udf(T.StructType().add("key", T.ArrayType(T.LongType())).add("reach", T.ArrayType(T.IntegerType())))
    def kept(sizes: pd.Series, keys: pd.Series) -> pd.DataFrame:
        out, reach = [], []
        for n, k in zip(sizes, keys, strict=True):
            k = np.asarray(k, dtype=np.int64)
            at = np.flatnonzero(is_set(k) & is_set(k >> SECOND))
            out.append(k[at])
            reach.append((n - at).astype(np.int32))
        return pd.DataFrame({"key": pd.Series(out, dtype=object), "reach": pd.Series(reach, dtype=object)})

    return kept


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t, WIDTH).view(np.int64) for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def _bitmaps_allow(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
    differ = np.empty(len(na), dtype=np.int64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        size = min(len(x), len(y))
        x, y = (folded(np.frombuffer(v, dtype=np.uint8)[None, :], size) for v in (x, y))
        differ[k] = np.bitwise_count(x ^ y).sum()
    return pd.Series(_may_link(na.to_numpy(), nb.to_numpy(), differ))


@F.pandas_udf(T.BooleanType())
def _sets_linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.asarray(x).view(U), np.asarray(y).view(U)  # sorted as unsigned
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        out.append(100 * common >= PERCENT * (len(x) + len(y) - common))
    return pd.Series(out, dtype=bool)


def _similar(a: Column, b: Column) -> Column:
    """Sizes alone allow a similarity of PERCENT."""
    return PERCENT * F.greatest(a, b) <= 100 * F.least(a, b)


def size_band(n: Column, parts: int = 1) -> Column:
    """Sizes of one band (cut in so many parts) differ by less than the ratio the similarity allows; partners are in one or two neighbours."""
    return F.floor((F.log(n.cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9) * parts).cast("int")


def _within_reach(na: Column, a: Column, nb: Column, b: Column) -> Column:
    """Sets of these sizes and reaches can reach the similarity by shingles from the tile's on."""
    return (100 + PERCENT) * F.least(a, b) >= PERCENT * (na + nb)


def _met(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes without those that are not among the ids (node), so that bitmaps of these stay where they are; all nodes if the ids are many."""
    ids = stored(ids.distinct(), "met")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return nodes.join(F.broadcast(ids), "node", "left_semi") if few else nodes


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps, and then full sets, reach the similarity."""
    near = _met(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left = near.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = near.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    passed = pairs.join(right, "b").join(left, "a").where(_bitmaps_allow("na", "ba", "nb", "bb"))
    passed = stored(passed.select("a", "b"), "passed")
    wanted = passed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(nodes.join(wanted, "node").select("node", "doc_id", "th"), "wanted")
    side = broadcast_if_small(wanted, BROADCAST_ROWS)
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = texts.join(side, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["th"])).select("node", "text")
    sets = stored(found.dropDuplicates(["node"]).select("node", _set_udf("text").alias("set")), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return passed.join(right, "b").join(left, "a").where(_sets_linked("sa", "sb")).select("a", "b")


def _with_partners(members: DataFrame) -> DataFrame:
    """The members whose tile may hold a partner of another component: by sizes, reaches and components of each part of a band."""
    members = members.withColumn("band", size_band(F.col("n")))
    parts = members.groupBy("key", "band", size_band(F.col("n"), PARTS).alias("part")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("reach"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    near = parts.withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    company = stored(near.groupBy("key", "band").agg(F.collect_list(F.struct("least", "most", "reach", "lo", "hi")).alias("company")), "company")  # 3 * PARTS at most

    def fits(c: Column) -> Column:
        n = F.col("n")
        sizes = (100 * c["most"] >= PERCENT * n) & (PERCENT * c["least"] <= 100 * n)
        least = F.greatest(c["least"], F.ceil(n * PERCENT / 100))
        return sizes & _within_reach(n, F.col("reach"), least, c["reach"]) & ((c["lo"] != F.col("comp")) | (c["hi"] != F.col("comp")))

    return members.join(company, ["key", "band"]).where(F.exists("company", fits)).select("key", "node", "n", "reach", "deg", "comp", "m")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, n, reach, deg, comp of the tiles that still hold several components, m members; of large ones only those that may still be linked."""
    known = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = stored(known, "known")
    tiles = known.groupBy("key").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi"), F.count(F.lit(1)).alias("m"))
    left = stored(known.join(stored(tiles.where("__lo <> __hi").select("key", "m"), "apart"), "key"), "mixed")
    large = stored(left.where(F.col("m") > SMALL), "large")
    return stored(left.where(F.col("m") <= SMALL).select("key", "node", "n", "reach", "deg", "comp", "m").unionByName(_with_partners(large)), "unsettled")


def _candidates_in_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components, one of each block, that sizes, reaches and bitmaps allow."""
    left, right = pdf[pdf["left"]], pdf[pdf["right"]]
    out = []
    for ((wl, hl), x), ((wr, hr), y) in ((p, q) for p in left.groupby(["width", "home"]) for q in right.groupby(["width", "home"])):
        if not hl and not hr:  # visitors meet in the tile of their own band
            continue
        size = min(wl, wr)
        a, b = (folded(np.frombuffer(b"".join(v["bits"]), dtype=np.uint8).reshape(len(v), -1), size).view(np.uint64) for v in (x, y))
        differ = np.zeros((len(a), len(b)), dtype=np.int64)
        for k in range(a.shape[1]):
            differ += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
        na, nb, ra, rb, ca, cb, ia, ib = (v[c].to_numpy() for c in ("n", "reach", "comp", "node") for v in (x, y))
        near = (100 + PERCENT) * np.minimum(ra.astype(np.int64)[:, None], rb[None, :]) >= PERCENT * (na[:, None] + nb[None, :])
        i, j = np.nonzero(near & _may_link(na[:, None], nb[None, :], differ) & (ca[:, None] != cb[None, :]))
        out.append(pd.DataFrame({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j])}))
    return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")


def _pairs_within(members: DataFrame) -> DataFrame:
    """All pairs across components that sizes and reaches allow; for tiles of at most SMALL members."""
    other = members.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("reach").alias("rb"), F.col("comp").alias("cb"))
    across = (F.col("comp") < F.col("cb")) & _similar(F.col("n"), F.col("nb")) & _within_reach(F.col("n"), F.col("reach"), F.col("nb"), F.col("rb"))
    return members.join(other, "key").where(across).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _dealt(members: DataFrame) -> DataFrame:
    """Members of large tiles, copied to the pairs of blocks (bl, br) that they are compared in.

    A tile's home nodes (of its band) meet home nodes and visitors (of the next). Two nodes of different
    components are not both of the tile's largest component: the others (minor) are cut into blocks of about BLOCK
    that meet each other and the blocks of the largest, whose members are copied once a block of the minor.
    """
    banded = members.select("key", "node", "reach", "comp", size_band(F.col("n")).alias("own"))
    homes = banded.select("key", F.col("own").alias("band"), "node", "reach", "comp", F.lit(True).alias("home"))
    tiles = homes.unionByName(banded.select("key", (F.col("own") - 1).alias("band"), "node", "reach", "comp", F.lit(False).alias("home")))
    parts = tiles.groupBy("key", "band", "comp").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("any"))
    sizes = parts.groupBy("key", "band").agg(F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("big"), F.max("any").alias("any")).where("any and all > big.m")
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    sizes = stored(sizes.select("key", "band", F.col("big.comp").alias("largest"), blocks(F.col("all") - F.col("big.m")).alias("few"), blocks(F.col("big.m")).alias("many")), "tiles")
    placed = tiles.join(sizes, ["key", "band"]).withColumn("minor", F.col("comp") != F.col("largest"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("minor"), own).otherwise(F.col("few") + own))
    met = F.when(F.col("minor"), F.col("few") + F.col("many")).otherwise(F.col("few"))  # the minor's blocks come first
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    left = F.col("block") <= F.col("other")
    return placed.select("key", "band", "node", "reach", "comp", "home", F.least("block", "other").alias("bl"), F.greatest("block", "other").alias("br"), left.alias("left"), (~left | (F.col("block") == F.col("other"))).alias("right"))


def _pairs_by_blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different components of a large tile that sizes, reaches and bitmaps allow."""
    shipped = _dealt(members).join(_met(nodes, members.select("node")).select("node", "n", "bits", F.length("bits").alias("width")), "node")
    return shipped.groupBy("key", "band", "bl", "br").applyInPandas(_candidates_in_block, "a long, b long").distinct()


@contextmanager
def _small_batches(spark: SparkSession):
    """Texts and sets go to Python in batches of BATCH rows, as a row may hold thousands of shingles."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def linked_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    with _small_batches(docs.sparkSession):
        return _linked(docs)


def _linked(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    describe = _describe(frequency_levels(docs))
    rows = stored(
        docs.select("doc_id", F.xxhash64("text").alias("th"), describe("text").alias("s"))
        .select("doc_id", "th", "s.*")
        .withColumn("rid", F.monotonically_increasing_id()),
        "described",
    )
    full = rows.where("n > 0")
    # Shingles that more than one row may hold, as a bitmap of a fixed size; most are held by one and go no further.
    held = full.select(F.explode("first").alias("key")).select(F.col("key").bitwiseAND(F.lit(TOLD_APART)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    maybe_shared = _kept_by(key_bitmap(held))
    classes = stored(full.groupBy("fp").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("__c")), "classes")
    repeated = broadcast_if_small(classes.where("__c > 1").select("fp", "node"))
    copies = stored(full.select("fp", "rid").join(repeated, "fp").where("rid <> node").select(F.col("rid").alias("node")), "copies")
    nodes = full.select(F.col("rid").alias("node"), "doc_id", "th", "n", "bits")  # only the classes' least rows are ever met
    kept = full.select(F.col("rid").alias("node"), "n", maybe_shared("n", "first").alias("m")).select("node", "n", F.col("m.key").alias("key"), F.col("m.reach").alias("reach"))
    kept = stored(kept.where(F.size("key") > 0).join(broadcast_if_small(copies), "node", "left_anti"), "kept")
    meets = kept.select("node", "n", F.explode(F.arrays_zip("key", "reach")).alias("m")).select("node", "n", "m.key", "m.reach")
    shared = meets.groupBy("key").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
    crowded = stored(meets.join(stored(shared, "shared"), "key"), "crowded")
    degree = crowded.groupBy("node").agg(F.sum("__c").alias("deg"))
    live = stored(crowded.withColumnRenamed("__c", "m").join(degree, "node").withColumn("comp", F.col("node")), "live")

    links, labels = None, None
    for _ in range(PIVOTS):
        pivot = stored(live.groupBy("key").agg(F.max(F.struct("deg", "node", "n", "reach", "comp")).alias("p")), "pivots")
        members = live.join(pivot, "key").where("node <> p.node")
        apart = (F.col("comp") != F.col("p.comp")) & _similar(F.col("n"), F.col("p.n")) & _within_reach(F.col("n"), F.col("reach"), F.col("p.n"), F.col("p.reach"))
        pairs = members.where(apart).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        found = _confirmed(stored(pairs, "pairs"), nodes, docs)
        links = stored(found if links is None else links.union(found), "links")
        labels = components(links)
        live = _unsettled(members.where("m > 2").select("key", "node", "n", "reach", "deg"), labels)  # of two, one is the pivot

    sizes = live.groupBy("key").agg((F.count(F.lit(1)) <= SMALL).alias("small"))
    rest = stored(live.join(stored(sizes, "sizes"), "key"), "rest")
    pairs = _pairs_within(rest.where("small")).union(_pairs_by_blocks(rest.where("not small"), nodes))
    more = stored(_confirmed(stored(pairs.distinct(), "pairs"), nodes, docs), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    grouped = classes.join(labels, "node", "left").select("fp", "low", F.coalesce("comp", "node").alias("comp"))
    lowest = grouped.groupBy("comp").agg(F.min("low").alias("component_id"))
    answer = grouped.join(lowest, "comp").select("fp", "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(answer, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(empty)

