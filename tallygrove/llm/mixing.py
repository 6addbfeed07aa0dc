"""Mixing sources to target weights by weighted fair queueing.

Every document joins its source's queue in a shuffled order; its virtual finish
time is the source's cumulative words divided by the source's weight. A further
epoch queues the source again behind itself, up to `max_epochs`. All copies are
range-sorted by finish time and the sort is cut at the total word budget, so a
source that runs out leaves its share to the others in proportion to weight.

Defined cases: null or empty text has size 0 and takes no budget; null is a
source of its own, last in order; rows equal in doc_id and text share one place
in the queue and one verdict; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import running_totals, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def _place(doc_id: Column, text: Column, seed: int) -> list[Column]:
    """The shuffled place in the source's queue: 128 hash bits of id and text."""
    return [
        F.xxhash64(F.lit(seed), doc_id, text).alias("__h1"),
        F.xxhash64(F.lit(seed + 1), text, doc_id).alias("__h2"),
    ]


def queue_rows(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), *_place(F.col("doc_id"), F.col("text"), seed)
    )


def source_targets(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> tuple[DataFrame, int]:
    """Per source: rank, weight, source_size, first (words of sources before it), target; and the budget.

    Targets fill like water: weight x level, at most max_epochs x size.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(sizes, [F.col("source")], "source_size", "__upto", "rank")
    sources = stored(
        ranked.select(
            "source",
            "source_size",
            (F.col("__upto") - F.col("source_size")).alias("first"),
            F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        ).withColumn("full_at", max_epochs * F.col("source_size") / F.col("weight")),
        "sources",
    )
    words, weight_sum = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    budget = int(words * share)
    filled = running_totals(sources, [F.col("full_at"), F.col("source")], "source_size", "__size", "__r1")
    filled = running_totals(filled, [F.col("full_at"), F.col("source")], "weight", "__weight", "__r2")
    level = (F.lit(float(budget)) - max_epochs * (F.col("__size") - F.col("source_size"))) / (
        F.lit(float(weight_sum)) - (F.col("__weight") - F.col("weight"))
    )
    cut = (
        filled.where(F.lit(weight_sum) - (F.col("__weight") - F.col("weight")) > 0)
        .withColumn("__level", level)
        .where(F.col("__level") <= F.col("full_at"))
        .agg(F.min_by("__level", "__r1"))
        .first()[0]
    )
    cap = (max_epochs * F.col("source_size")).cast("double")
    target = cap if cut is None else F.least(cap, F.col("weight") * F.lit(float(cut)))
    return sources.withColumn("target", target), budget


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: target, and the last place in the queue that the budget reaches.

    rows: queue_rows(), stored. The cut is a prefix of each source's queue, so
    it is told by its last element and documents need not be shuffled again.
    """
    sources, budget = source_targets(rows, weights, share, max_epochs)
    queued = running_totals(
        rows.select("source", "size", "__h1", "__h2"),
        [F.col("source"), F.col("__h1"), F.col("__h2"), F.col("size")],
        "size",
        "__upto",
        "__rank",
    )
    own = sources.select(F.col("source").alias("__source"), "source_size", "first", "weight")
    copies = (
        queued.join(own, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("__upto") - F.col("first")) / F.col("weight"))
        .select("source", "size", "epoch", "__h1", "__h2", "finish")
    )
    line = running_totals(
        copies,
        [F.col("finish"), F.col("source"), F.col("epoch"), F.col("__h1"), F.col("__h2")],
        "size",
        "__taken",
        "__rank",
    )
    last = (
        line.where(F.col("__taken") <= budget)
        .groupBy(F.col("source").alias("__source"))
        .agg(F.max(F.struct("epoch", "__h1", "__h2")).alias("__last"))
    )
    return stored(
        sources.join(last, F.col("source").eqNullSafe(F.col("__source")), "left").select(
            F.col("source").alias("__source"), "source_size", "target", "__last"
        ),
        "mixplan",
    )


def with_copies(rows: DataFrame, plan: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds source_size, target and `copies` (how often the mix takes the row).

    The plan has one row per source; Spark broadcasts it below its own size
    threshold and otherwise joins with skew handling.
    """
    taken = [
        F.when(F.struct(F.lit(e).alias("epoch"), F.col("__h1"), F.col("__h2")) <= F.col("__last"), 1).otherwise(0)
        for e in range(max_epochs)
    ]
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("copies", sum(taken[1:], taken[0]))
        .drop("__source", "__last")
    )


def mixed_sizes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every document."""
    rows = stored(queue_rows(docs, seed), "queue")
    placed = with_copies(rows, mix_plan(rows, weights, share, max_epochs), max_epochs)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of docs, one row per copy taken.

    Texts are not shuffled. A document without words is taken once at most.
    """
    rows = stored(queue_rows(docs, seed), "queue")
    placed = docs.withColumns(
        {"__size": word_count(F.col("text")), **{n: c for n, c in zip(("__h1", "__h2"), _place(F.col("doc_id"), F.col("text"), seed))}}
    )
    plan = mix_plan(rows, weights, share, max_epochs).select("__source", "__last")
    times = F.when(F.col("__size") == 0, F.least(F.col("__copies"), F.lit(1))).otherwise(F.col("__copies"))
    taken = [
        F.when(F.struct(F.lit(e).alias("epoch"), F.col("__h1"), F.col("__h2")) <= F.col("__last"), 1).otherwise(0)
        for e in range(max_epochs)
    ]
    return (
        placed.join(plan, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__copies", sum(taken[1:], taken[0]))
        .where("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), times)))
        .select(*docs.columns)
    )
