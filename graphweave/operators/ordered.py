"""Positions, running sums and values carried down a whole table, without a task that holds it all.

Rows are dealt by ranges of the order and written by a checkpoint, so that all steps
see the same parts; what goes from part to part is a table of one row a part.  Callers
need a checkpoint folder.  The order must be total, or equal rows take any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *order) -> DataFrame:
    """The rows with the number of their range, ``_part``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).checkpoint()


def running_sum(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each row, 0 on the first."""
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    own = dealt(rows.withColumn("_value", value), *order)
    total = own.groupBy("_part").agg(F.sum("_value").alias("_total")).select("_part", F.coalesce(F.sum("_total").over(before(W.orderBy("_part"))), none).alias("_base"))
    inside = own.withColumn("_inside", F.coalesce(F.sum("_value").over(before(W.partitionBy("_part").orderBy(*order))), none))
    return inside.join(F.broadcast(total), "_part").select(*rows.columns, (F.col("_base") + F.col("_inside")).alias(name))


def positions(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds each row's position from 0."""
    return running_sum(rows, order, F.lit(1).cast("long"), name)


def carried(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null up to each row."""
    own = dealt(rows.withColumn("_value", value), order)
    last = own.groupBy("_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
    over = last.select("_part", F.last("_last", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_base"))
    inside = own.withColumn("_inside", F.last("_value", ignorenulls=True).over(W.partitionBy("_part").orderBy(order)))
    return inside.join(F.broadcast(over), "_part").select(*rows.columns, F.coalesce("_inside", "_base").alias(name))
