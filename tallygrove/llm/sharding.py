"""Sharding by sampled splitters.

Keys are (hash of text, hash of id and text), so equal texts are neighbours.
Size-weighted key samples give quantile boundaries; records are cut into ranges
there, exact range sizes are counted, and ranges that hold over twice their
share are resampled and subdivided. The law is `bytes`: shards have near equal
sizes, and equal texts share a shard.

A group of equal texts above `LARGE` of a shard would leave a shard uneven
wherever a boundary met it, so such groups (at most n_shards / LARGE) are dealt
first: one of up to a shard goes whole to the emptiest shard, largest first;
one above a shard, the only kind that is cut, fills emptiest shards in turn.
The other groups then fill what is left of each shard in key order: a group
goes where the middle of its bytes falls.

Defined cases: null text has 0 bytes of text and is a group of its own; empty
texts form one group; rows equal in id and text are neighbours in any order; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrove.llm.common import stored, uniform

N_SHARDS = 40
OVERHEAD = 16
#: Share of a shard above which a group of equal texts is dealt by itself.
LARGE = 0.02
_LEAST = -(1 << 63)


@dataclass
class ShardPlan:
    bounds: list[tuple[int, int]]
    offsets: DataFrame
    starts: DataFrame | None
    #: Large groups: key -> [(end of the piece in the group's bytes, shard)].
    dealt: dict[int, list[tuple[int, int]]]
    #: Bytes of other groups up to the end of each shard.
    room: list[float]
    n_shards: int


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def with_keys(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.withColumns(
        {"__k1": F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), "__k2": F.xxhash64(F.lit(3), F.col("doc_id"), text), "__size": record_size(text)}
    )


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below the key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = []
    width = 1
    while width <= len(bounds):
        steps.insert(0, width)
        width *= 2
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in bounds))
    key = F.struct(F.col("__k1").alias("a"), F.col("__k2").alias("b"))
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at),
    )


def _quantiles(sample: list, pieces: int, least: float) -> list[tuple[int, int]]:
    """Keys that cut the weighted sample into `pieces` of equal weight."""
    sample = sorted((r[0], r[1], max(float(r[2]), least)) for r in sample)
    whole, so_far, cuts = sum(w for _, _, w in sample), 0.0, []
    for a, b, w in sample:
        if so_far >= whole * (len(cuts) + 1) / pieces:
            cuts.append((a, b))
        so_far += w
    return cuts


def deal_large(groups: list[tuple[int, int]], total: int, n_shards: int) -> tuple[dict[int, list[tuple[int, int]]], list[float]]:
    """Pieces of the large groups (key, bytes), and the bytes of other groups up to the end of each shard."""
    share = total / n_shards
    load = [(0.0, s) for s in range(n_shards)]
    dealt: dict[int, list[tuple[int, int]]] = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        pieces, at = [], 0
        while at < size:
            used, shard = heapq.heappop(load)
            piece = size - at if size <= share else min(size - at, max(1, math.ceil(share - used)))
            heapq.heappush(load, (used + piece, shard))
            at += piece
            pieces.append((at, shard))
        dealt[key] = pieces
    # What is left is shared so that no shard ends above `level`: fill up the emptiest first.
    used = dict((s, u) for u, s in load)
    left, level, width = float(total - sum(used.values())), 0.0, 0
    rising = sorted(used.values())
    for k, u in enumerate(rising):
        filled = k * u - sum(rising[:k])
        if filled > left:
            break
        level, width = u, k + 1
    level = (left + sum(rising[:width])) / width if width else level
    room, so_far = [], 0.0
    for s in range(n_shards):
        so_far += max(0.0, level - used[s])
        room.append(so_far)
    return dealt, room


def plan_shards(keyed: DataFrame, n_shards: int = N_SHARDS, oversample: int = 16, large: float = LARGE) -> ShardPlan:
    """keyed: a stored table with __k1, __k2, __size.

    The driver holds at most 4,096 boundaries, about 65,000 sampled keys and n_shards / large groups.
    """
    rows, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    total = max(1, total)
    pieces = min(4096, max(4 * n_shards, rows // 100_000))
    big = keyed.groupBy("__k1").agg(F.sum("__size").alias("__g")).where(F.col("__g") > large * total / n_shards).collect()
    dealt, room = deal_large([tuple(r) for r in big], total, n_shards)

    def drawn(frame: DataFrame, n_bytes: int, want: int, salt: int) -> tuple[list, float]:
        each = n_bytes / want
        chosen = uniform(F.lit(salt), F.col("__k1"), F.col("__k2")) < F.col("__size") / F.lit(each)
        return frame.where(chosen).select("__k1", "__k2", "__size").collect(), each

    def groupwise(bounds: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Only a large group may lie in two ranges."""
        return {(a, b if a in dealt else _LEAST) for a, b in bounds}

    bounds = sorted({(a, _LEAST) for a, _ in _quantiles(*_with(drawn(keyed, total, pieces * oversample, 1), pieces))})
    for depth in range(4):
        ranged = keyed.withColumn("__range", _range_of(bounds))
        sizes = {r[0]: r[1] for r in ranged.groupBy("__range").agg(F.sum("__size")).collect()}
        over = {k: v for k, v in sizes.items() if v > 2 * total / pieces}
        if not over or depth == 3:
            break
        share = {k: max(2, round(v * pieces / total)) for k, v in over.items()}
        inside = ranged.where(F.col("__range").isin(*over))
        sample, each = drawn(inside, sum(over.values()), sum(share.values()) * oversample, 2 + depth)
        lo = [(_LEAST, _LEAST), *bounds]
        more: set[tuple[int, int]] = set()
        for k, n in share.items():
            top = bounds[k] if k < len(bounds) else (1 << 63, 0)
            more |= groupwise(set(_quantiles([r for r in sample if lo[k] <= (r[0], r[1]) < top], n, each)))
        if more <= set(bounds):
            break
        bounds = sorted(set(bounds) | more)

    # Totals of each range, for large groups and for the others apart.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    apart = {"l": F.col("__large"), "o": ~F.col("__large")}
    sums = [F.sum(F.when(c, x).otherwise(0)).alias(f"{n}{k}") for k, c in apart.items() for n, x in (("__b", F.col("__size")), ("__n", F.lit(1)))]
    offsets = stored(
        keyed.withColumn("__large", _is_large(dealt))
        .groupBy(_range_of(bounds).alias("__range"))
        .agg(*sums)
        .select("__range", *(F.coalesce(F.sum(f"{n}{k}").over(before), F.lit(0)).alias(f"{n}{k}") for k in apart for n in ("__b", "__n"))),
        "offsets",
    )
    plan = ShardPlan(bounds, offsets, None, dealt, room, n_shards)
    pieces_of = _placed(keyed.select("__k1", "__k2", "__size"), plan).groupBy("shard", "__piece").agg(F.min("__row").alias("__start"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    plan.starts = stored(pieces_of.select("shard", "__piece", "__start", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__slots")), "starts")
    return plan


def _with(drawn: tuple[list, float], pieces: int) -> tuple[list, int, float]:
    return drawn[0], pieces, drawn[1]


def _is_large(dealt: dict[int, list[tuple[int, int]]]) -> Column:
    return F.col("__k1").isin(*dealt) if dealt else F.lit(False)


def _placed(keyed: DataFrame, plan: ShardPlan) -> DataFrame:
    """Adds shard, __piece (0 for small groups, else the piece of a large group) and __row (rising within a piece).

    Each window holds one range only.
    """
    along = Window.partitionBy("__range", "__large").orderBy("__k1", "__k2")
    group = Window.partitionBy("__range", "__large", "__k1")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    numbered = sorted((key, end, shard) for key, pieces in plan.dealt.items() for end, shard in pieces)
    # Ends of all pieces in the order of keys; a record's piece is where the middle of its bytes falls.
    ends, at = [], 0
    for k, (key, end, _) in enumerate(numbered):
        at += end - (numbered[k - 1][1] if k and numbered[k - 1][0] == key else 0)
        ends.append(at)
    shards = F.array(*(F.lit(s) for _, _, s in numbered)) if numbered else F.array(F.lit(0))
    own_middle = F.col("__at") + F.col("__size") / 2
    group_middle = F.min("__at").over(group) + F.sum("__size").over(group) / 2
    return (
        keyed.withColumn("__range", _range_of(plan.bounds))
        .withColumn("__large", _is_large(plan.dealt))
        .join(F.broadcast(plan.offsets), "__range")  # at most 4,096 boundaries and a few times as many subdivisions
        .withColumn("__row", F.row_number().over(along) + F.when(F.col("__large"), F.col("__nl")).otherwise(F.col("__no")))
        .withColumn("__at", F.sum("__size").over(upto) - F.col("__size") + F.when(F.col("__large"), F.col("__bl")).otherwise(F.col("__bo")))
        .withColumn("__middle", F.when(F.col("__large"), own_middle).otherwise(group_middle))
        .withColumn("__piece", F.when(F.col("__large"), F.least(F.lit(max(1, len(ends))), 1 + _steps_below(ends, F.col("__middle")))).otherwise(0))
        .withColumn("shard", F.when(F.col("__large"), F.get(shards, F.col("__piece") - 1)).otherwise(F.least(F.lit(plan.n_shards - 1), _steps_below(plan.room, F.col("__middle")))))
        .drop("__range", "__large", "__bl", "__bo", "__nl", "__no", "__at", "__middle")
    )


def _steps_below(ends: list, value: Column) -> Column:
    """How many of the ascending `ends` are at or below the value, by binary search."""
    steps, width = [], 1
    while width <= len(ends):
        steps.insert(0, width)
        width *= 2
    if not steps:
        return F.lit(0)
    table = F.array(*(F.lit(float(e)) for e in ends))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def place(keyed: DataFrame, plan: ShardPlan) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard)."""
    return (
        _placed(keyed, plan)
        .join(F.broadcast(plan.starts), ["shard", "__piece"])  # a row per shard and per piece of a large group
        .withColumn("slot", (F.col("__row") - F.col("__start") + F.col("__slots")).cast("long"))
        .drop("__row", "__start", "__slots", "__piece", "__k1", "__k2", "__size")
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The columns of docs with shard and slot."""
    keys = stored(with_keys(docs).select("__k1", "__k2", "__size"), "keys")
    return place(with_keys(docs), plan_shards(keys, n_shards)).select(*(c for c in docs.columns if c.lower() not in ("shard", "slot")), "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, records in slot order; each shard may take several files."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; texts are not shuffled."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = stored(with_keys(docs).select("doc_id", "__k1", "__k2", "__size", F.col("__size").alias("size"), crc.alias("text_crc32")), "keys")
    return place(rows, plan_shards(rows, n_shards)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
