"""Helpers shared by the training-data operators.

Column names that start with two underscores are internal; an input column of
the same name as an output column is replaced by the output.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows (of a few longs) up to which a side is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is set, a temporary one if all runs on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage with columnar files that survive lost executors. The
    tables stay, as results read them later, until `discard_stored`.
    """
    path = f"{_tables(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Delete all tables that `stored` wrote in this application; results that were not written out are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that df has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids count as 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))).cast("double")


def running_totals(df: DataFrame, order: list[Column], value: str, total: str, rank: str) -> DataFrame:
    """Adds `total` (inclusive running sum of `value`) and `rank` (from 1) along `order`.

    Rows are range-partitioned; only one total per partition is ever brought
    together, so no task sees more than its own range. `df` must be narrow.
    """
    parts = stored(
        df.select("*", *(c.alias(f"__o{i}") for i, c in enumerate(order)))
        .repartitionByRange(*(F.col(f"__o{i}").asc_nulls_last() for i in range(len(order))))
        .withColumn("__part", F.spark_partition_id()),
        "ranges",
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("__part")
        .agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
        .select(
            "__part",
            F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__sum0"),
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        )
    )
    along = Window.partitionBy("__part").orderBy(*(F.col(f"__o{i}").asc_nulls_last() for i in range(len(order))))
    return (
        parts.join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(rank, F.row_number().over(along) + F.col("__n0"))
        .withColumn(total, F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__sum0"))
        .drop("__part", "__sum0", "__n0", *(f"__o{i}" for i in range(len(order))))
    )
