"""Which entities have changed: a stateful stream that keeps a digest of every entity's facts.

Facts arrive, arrive again and are corrected. For each entity the state holds
what each of its facts said last (a hash under a hash of the fact's key) and the
sum of these hashes, the digest. A micro-batch emits an entity only if its digest
is another one afterwards, so redelivered facts emit nothing and recompute nothing.

An entity's facts are spread over `shards` keys of state by the fact's key, so
one entity with most of the facts is not one task; the shards of an entity emit
apart, and its digest is their sum. State lives in RocksDB, on the executors'
disks and in the checkpoint, and a fact not seen for `ttl` leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallygrove.sources.merge import by_entity, merge

SHARDS = 16
TTL = timedelta(days=400)
CHANGES = "entity string, shard int, digest long, facts long, changed long"
#: State in RocksDB; no batches without data, which would go on for ever under a time to live.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _wrapped(x: int) -> int:
    """As a signed 64-bit number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def digest_change(before: dict[int, int | None], now: dict[int, int]) -> tuple[int, int, int]:
    """(what the digest grows by, new facts, changed facts) for the last known and the new hash of each fact."""
    grown = sum(c - (before[f] or 0) for f, c in now.items() if before[f] != c)
    return grown, sum(before[f] is None for f in now), sum(before[f] != c for f, c in now.items())


class EntityDigest(StatefulProcessor):
    def __init__(self, ttl: timedelta = TTL):
        self.ttl = int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "fact long", "content long", ttlDurationMs=self.ttl)
        self.total = handle.getValueState("total", "digest long, facts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now: dict[int, tuple] = {}
        for pdf in rows:
            for place, fact, content in zip(pdf["place"], pdf["fact"], pdf["content"], strict=True):
                if fact not in now or now[fact] <= (place, content):
                    now[fact] = (place, content)
        latest = {int(f): int(c) for f, (_, c) in now.items()}
        known = {f: self.seen.getValue((f,)) for f in latest}
        before = {f: None if v is None else int(v[0]) for f, v in known.items()}
        grown, fresh, changed = digest_change(before, latest)
        for f, c in latest.items():
            self.seen.updateValue((f,), (c,))  # also of unchanged facts, so that they stay
        digest, facts = self.total.get() if self.total.exists() else (0, 0)
        if changed:
            self.total.update((_wrapped(digest + grown), facts + fresh))
            yield pd.DataFrame({"entity": [key[0]], "shard": [key[1]], "digest": [_wrapped(digest + grown)], "facts": [facts + fresh], "changed": [changed]})

    def close(self) -> None:
        pass


def hashed_facts(facts: DataFrame, key: tuple[str, ...], values: tuple[str, ...], order: str, shards: int = SHARDS) -> DataFrame:
    """entity, shard, fact, content and place of each row; of rows of one key the last by `order` counts."""
    fact = F.xxhash64(*(F.col(c) for c in key))
    content = F.xxhash64(*(F.col(c) for c in values), fact)
    return facts.select("entity", F.pmod(fact, F.lit(shards)).cast("int").alias("shard"), fact.alias("fact"), content.alias("content"), F.col(order).alias("place"))


def changes(facts: DataFrame, key: tuple[str, ...], values: tuple[str, ...], order: str, ttl: timedelta = TTL, shards: int = SHARDS) -> DataFrame:
    """A stream of facts to the stream of changed entities (CHANGES), one row a shard and micro-batch."""
    return hashed_facts(facts, key, values, order, shards).groupBy("entity", "shard").transformWithStateInPandas(EntityDigest(ttl), CHANGES, "Update", "ProcessingTime")


@contextmanager
def stateful(spark: SparkSession):
    """Queries started within keep their state in RocksDB and run for data only."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def on_changes(changed: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs what is there; act(entities, batch number) gets the distinct changed entities of each batch that has any."""

    def each(batch: DataFrame, number: int) -> None:
        entities = batch.select("entity").distinct().persist()
        try:
            if not entities.isEmpty():
                act(entities, number)
        finally:
            entities.unpersist()

    with stateful(changed.sparkSession):
        return changed.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recompute_changed(changed: DataFrame, facts: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Puts compute(facts of the changed entities) in place of these entities' rows in `target`; only partitions with such entities are written."""

    def act(entities: DataFrame, _number: int) -> None:
        merge(compute(facts().join(entities, "entity", "left_semi")), target, ("entity",), by_entity())

    return on_changes(changed, act, checkpoint)
