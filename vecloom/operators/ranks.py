"""Consecutive numbers in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.sources.scratch import settled


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with column `name`: 0, 1, 2, ... in the order of the given columns, which must tell all rows apart.

    Rows are dealt out by range and settled, so the ranges are fixed; each range is numbered by itself, and the counts of
    the ranges before it, a number each, are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    skip = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    own = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn("_at", F.row_number().over(own) - 1).join(skip, "_range").withColumn(name, F.col("_skip") + F.col("_at")).drop("_range", "_at", "_skip")
