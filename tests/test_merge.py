"""Merges rewrite the partitions they touch and no other."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tallygrove.sources import merge as U

SCHEMA = "key string, day date, value double, _row long"


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, day string, value double, _row long").withColumn("day", F.to_date("day"))


def rows_of(df):
    return sorted((r["key"], str(r["day"]), r["value"]) for r in df.collect())


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    months = U.by_month("day")
    assert U.merge(frame(spark, [("a", "2024-01-01", 1.0, 0), ("b", "2024-02-01", 2.0, 0), ("c", "2024-03-01", 3.0, 0)]), path, ("key", "day"), months, "_row") == 3
    before = files(path)
    assert U.merge(frame(spark, [("b", "2024-02-01", 9.0, 1), ("b", "2024-02-01", 8.0, 2), ("d", "2024-02-03", 4.0, 1), ("e", None, 5.0, 1)]), path, ("key", "day"), months, "_row") == 2
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) == 2 and all("2024-01" in f or "2024-03" in f for f in same)
    assert rows_of(spark.read.parquet(path)) == [("a", "2024-01-01", 1.0), ("b", "2024-02-01", 8.0), ("c", "2024-03-01", 3.0), ("d", "2024-02-03", 4.0), ("e", "None", 5.0)]
    assert U.merge(frame(spark, [("e", None, 6.0, 1)]), path, ("key", "day"), months, "_row") == 1  # null keys meet
    assert rows_of(spark.read.parquet(path))[-1] == ("e", "None", 6.0)
    again = files(path)
    assert U.merge(frame(spark, [("z", "2024-01-01", 1.0, 0)]).limit(0), path, ("key", "day"), months, "_row") == 0 and files(path) == again


def test_groups_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    part = U.by_entity("key", 4)
    U.merge(frame(spark, [("a", "2024-01-01", 1.0, 0), ("a", "2024-02-01", 2.0, 0), ("b", "2024-01-01", 3.0, 0)]).drop("_row"), path, ("key",), part)
    U.merge(frame(spark, [("a", "2024-05-01", 7.0, 0)]).drop("_row"), path, ("key",), part)
    assert rows_of(spark.read.parquet(path)) == [("a", "2024-05-01", 7.0), ("b", "2024-01-01", 3.0)]


def test_tables_by_name(spark, tmp_path):
    spark.sql(f"create database merge_test location '{tmp_path}'")
    for day, value in (("2024-01-01", 1.0), ("2024-02-01", 2.0), ("2024-01-01", 5.0)):
        U.merge(frame(spark, [("a", day, value, 0)]), "merge_test.t", ("key", "day"), U.by_month("day"), "_row")
    assert rows_of(spark.table("merge_test.t")) == [("a", "2024-01-01", 5.0), ("a", "2024-02-01", 2.0)]
    spark.sql("drop database merge_test cascade")


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    U.merge(frame(spark, [("a", f"2024-{m:02d}-01", 1.0, 0) for m in range(1, 13)]), path, ("key", "day"), U.by_month("day"), "_row")
    old = spark.read.parquet(path).where(U.touched_partitions(frame(spark, [("a", "2024-03-05", 1.0, 0)]).withColumns(U.by_month("day")), ["month_of"]))
    assert len(old.inputFiles()) == 12 and "PartitionFilters: [month_of" in old._jdf.queryExecution().toString().replace("isnotnull(month_of#", "month_of#")
    assert old.rdd.getNumPartitions() == 1
