"""Changed entities of a stream: two micro-batches, of which the second recomputes what it changes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallygrove.streaming import digests as D

SCHEMA = "entity string, ts string, metric string, value double, at long"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, shards=D.SHARDS):
    facts = spark.readStream.schema(SCHEMA).parquet(path)
    return D.changes(facts, ("entity", "metric", "ts"), ("value",), "at", shards=shards)


def test_second_batch_recomputes_one_entity(spark, tmp_path):
    path, target, check = (str(tmp_path / n) for n in ("facts", "kpis", "check"))
    rows = [(e, f"2024-{m:02d}", "mrr", float(m), 0) for e in ("a", "b", "c") for m in range(1, 7)]
    seen = []

    def compute(facts):
        out = facts.groupBy("entity").agg(F.sum("value").alias("total"))
        seen.append(sorted(r["entity"] for r in out.collect()))
        return out

    def latest():
        facts = spark.read.schema(SCHEMA).parquet(path)
        return facts.groupBy("entity", "metric", "ts").agg(F.max_by("value", "at").alias("value"))

    def run():
        D.recompute_changed(stream(spark, path), latest, compute, target, check).awaitTermination()
        return {r["entity"]: r["total"] for r in spark.read.parquet(target).collect()}

    land(spark, path, rows)
    assert run() == {"a": 21.0, "b": 21.0, "c": 21.0} and seen == [["a", "b", "c"]]
    land(spark, path, rows + [("b", "2024-02", "mrr", 5.0, 1)])  # everything again, and one correction
    assert run() == {"a": 21.0, "b": 24.0, "c": 21.0} and seen == [["a", "b", "c"], ["b"]]
    land(spark, path, rows[:4] + [("b", "2024-02", "mrr", 5.0, 2)])  # nothing new
    assert run() == {"a": 21.0, "b": 24.0, "c": 21.0} and len(seen) == 2
    land(spark, path, [("d", "2024-01", "mrr", 1.0, 3), ("a", "2024-07", "mrr", 1.0, 3)])
    assert run() == {"a": 22.0, "b": 24.0, "c": 21.0, "d": 1.0} and seen[2:] == [["a", "d"]]


@pytest.mark.parametrize("shards", [1, 5])
def test_digests_follow_the_facts(spark, tmp_path, shards):
    """After any batches, an entity's digest is the sum over its facts, whatever order they came in."""
    path, check, out = (str(tmp_path / n) for n in ("facts", "check", "out"))
    rnd = random.Random(shards)
    known, emitted = {}, {}
    for batch in range(3):
        rows = [(rnd.choice("abc"), f"t{rnd.randrange(4)}", "m", float(rnd.randrange(3)), 100 * batch + k) for k in range(25)]
        land(spark, path, rows)
        before = {e: frozenset((k, v) for k, v in known.items() if k[0] == e) for e in "abc"}
        for e, t, m, v, _ in rows:
            known[e, t, m] = v
        changed = {e for e in "abc" if before[e] != frozenset((k, v) for k, v in known.items() if k[0] == e)}
        with D.stateful(spark):
            stream(spark, path, shards).writeStream.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).where(F.col("batch") == batch).collect()
        assert {r["entity"] for r in rows} == changed
        emitted |= {(r["entity"], r["shard"]): (r["digest"], r["facts"]) for r in rows}
        facts = spark.createDataFrame([(e, t, m, v, 0) for (e, t, m), v in known.items()], SCHEMA)
        want = D.hashed_facts(facts, ("entity", "metric", "ts"), ("value",), "at", shards).groupBy("entity", "shard").agg(F.collect_list("content").alias("c")).collect()
        assert emitted == {(r["entity"], r["shard"]): (D._wrapped(sum(r["c"])), len(r["c"])) for r in want}


def test_digest_change():
    assert D.digest_change({1: None, 2: 5, 3: 7}, {1: 4, 2: 5, 3: 1}) == (4 - 6, 1, 2)
    assert D._wrapped((1 << 63) + 5) == -(1 << 63) + 5 and D._wrapped(-3) == -3
