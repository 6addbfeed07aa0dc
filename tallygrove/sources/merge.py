"""Upserts that rewrite only the partitions they touch.

A target is a partitioned Parquet table, by name or by path. Its partition
columns are expressions over the key, so a key's old and new row lie in one
partition: only partitions that incoming rows fall into are read and, by
dynamic partition overwrite, written again; the files of all others stay as
they are. The touched partitions' values come to the driver, which is what it
holds of any table's partitions anyway.

Spark writes the new files beside the old and moves them at the end, so a job
that loses executors starts over from unchanged data. Two merges into one target
at a time are the caller's to keep apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MODE = "spark.sql.sources.partitionOverwriteMode"
#: Partitions by which rows of an entity lie together.
BUCKETS = 64


def by_entity(entity: str = "entity", buckets: int = BUCKETS) -> dict[str, Column]:
    return {"bucket": F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")}


def by_month(day: str) -> dict[str, Column]:
    return {"month_of": F.date_format(day, "yyyy-MM")}


def _is_path(target: str) -> bool:
    return "/" in target


def target_exists(spark, target: str) -> bool:
    if not _is_path(target):
        return spark.catalog.tableExists(target)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read_target(spark, target: str) -> DataFrame:
    """The rows of a target; a table is read by its path, as Spark does not read a table that it writes."""
    if _is_path(target):
        return spark.read.parquet(target)
    where = spark.sql(f"describe formatted {target}").where("col_name = 'Location'").first()["data_type"]
    return spark.read.schema(spark.table(target).schema).parquet(where)


def last_per_key(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The row of each key with the greatest `order`; without `order` afterwards."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", order)


def touched_partitions(rows: DataFrame, columns: list[str]) -> Column:
    """A condition on partition columns that holds for the partitions the rows fall into."""
    values = [tuple(r) for r in rows.select(*columns).distinct().collect()]
    if len(columns) == 1:
        known = [v for (v,) in values if v is not None]
        found = F.col(columns[0]).isin(known)
        return found | F.col(columns[0]).isNull() if len(known) < len(values) else found
    each = (reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, row, strict=True))) for row in values)
    return reduce(Column.__or__, each, F.lit(False))


def merge(incoming: DataFrame, target: str, key: tuple[str, ...], partition: dict[str, Column], order: str | None = None) -> int:
    """Puts incoming rows in place of the target's rows of the same key; returns how many partitions were written.

    With `order`, the last incoming row of each key counts and the column is dropped; without, all incoming
    rows of a key replace all old ones. The target is made if it is not there. Columns that only one side has are null
    on the other; a new column is added in the partitions written (and by schema merging to a path's readers).
    """
    spark = incoming.sparkSession
    rows = last_per_key(incoming, key, order) if order else incoming
    rows = rows.withColumns(partition)
    names = list(partition)
    found = read_target(spark, target) if target_exists(spark, target) else None
    changed = rows.select(*names).distinct().count()
    if not changed:
        return 0
    if found is not None:
        old = found.where(touched_partitions(rows, names))
        same = reduce(Column.__and__, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key))
        kept = old.alias("o").join(rows.select(*key).distinct().alias("n"), same, "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    rows = rows.select(*(c for c in rows.columns if c not in names), *names).hint("rebalance", *names)  # large partitions go to several files
    if _is_path(target):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(target)
    elif found is None:
        rows.write.partitionBy(*names).saveAsTable(target)
    else:
        before = spark.conf.get(_MODE)
        spark.conf.set(_MODE, "dynamic")  # the writer's own option does not reach tables
        try:
            rows.select(*found.columns).write.mode("overwrite").insertInto(target)
        finally:
            spark.conf.set(_MODE, before)
    return changed
