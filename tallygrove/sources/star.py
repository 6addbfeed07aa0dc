"""Facts and series from the sales star schema.

`facts` is one row per order: the long fact table that all operators start
from. `series` is position-indexed: `seq` counts a metric's own periods, so lag
k is k rows. Dimension tables are joined with the planner's own choice of
strategy; the fact side is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Money enters series in millions.
UNIT = 1e6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_type, entity, category, metric, value, ts, region, segment, channel, customer, id."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.lit("csv").alias("source_type"),
        F.col("n_name").alias("entity"),
        F.lit("sales").alias("category"),
        F.lit("recurring_revenue").alias("metric"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("ts"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderkey").alias("id"),
    )


def monthly(rows: DataFrame) -> DataFrame:
    """entity, month, revenue, orders, active and next-month churn per entity and calendar month.

    A customer has churned in a month if no order follows within the next 90 days.
    """
    by_customer = Window.partitionBy("entity", "customer").orderBy("ts", "id")
    gone = F.lead("ts").over(by_customer)
    marked = rows.withColumn("lost", gone.isNull() | (F.datediff(gone, "ts") > 90))
    return (
        marked.groupBy("entity", F.trunc("ts", "month").alias("month"))
        .agg(
            F.round(F.sum("value"), 2).alias("revenue"),
            F.count(F.lit(1)).alias("orders"),
            F.countDistinct("customer").alias("active"),
            F.countDistinct(F.when(F.col("lost"), F.col("customer"))).alias("churned"),
        )
    )


def series(months: DataFrame) -> DataFrame:
    """entity, metric, seq (from 0), ts, value: four metrics per entity, in period order."""
    long = months.select(
        "entity",
        F.col("month").alias("ts"),
        F.explode(
            F.create_map(
                F.lit("recurring_revenue"), F.col("revenue") / UNIT,
                F.lit("order_count"), F.col("orders").cast("double"),
                F.lit("active_customer_count"), F.col("active").cast("double"),
                F.lit("arpu"), F.col("revenue") / F.col("active") / 1000,
            )
        ).alias("metric", "value"),
    )
    along = Window.partitionBy("entity", "metric").orderBy("ts")
    return long.select("entity", "metric", (F.row_number().over(along) - 1).alias("seq"), "ts", "value")


FACTS_SQL = """
facts AS (
  SELECT 'csv' AS source_type, n_name AS entity, 'sales' AS category, 'recurring_revenue' AS metric, o_totalprice AS value,
         o_orderdate AS ts, r_name AS region, c_mktsegment AS segment, o_orderpriority AS channel, o_custkey AS customer, o_orderkey AS id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

MONTHLY_SQL = (
    FACTS_SQL
    + """,
marked AS (
  SELECT *, lead(ts) OVER (PARTITION BY entity, customer ORDER BY ts, id) AS next_ts FROM facts
), monthly AS (
  SELECT entity, date_trunc('month', ts)::DATE AS month, round(sum(value), 2) AS revenue, count(*) AS orders,
         count(DISTINCT customer) AS active,
         count(DISTINCT CASE WHEN next_ts IS NULL OR date_diff('day', ts, next_ts) > 90 THEN customer END) AS churned
  FROM marked GROUP BY ALL
)"""
)

SERIES_SQL = (
    MONTHLY_SQL
    + """,
long AS (
  SELECT entity, 'recurring_revenue' AS metric, month AS ts, revenue / 1e6 AS value FROM monthly
  UNION ALL SELECT entity, 'order_count', month, orders::DOUBLE FROM monthly
  UNION ALL SELECT entity, 'active_customer_count', month, active::DOUBLE FROM monthly
  UNION ALL SELECT entity, 'arpu', month, revenue / active / 1000 FROM monthly
), series AS (
  SELECT entity, metric, row_number() OVER (PARTITION BY entity, metric ORDER BY ts) - 1 AS seq, ts, value FROM long
)"""
)
