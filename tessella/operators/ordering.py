"""Global positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.tables import stored


def with_running(df: DataFrame, value: Column, *order: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to each, in the order of ``order``, which must be unique.

    Rows are range-partitioned, stored and summed in their partition; the partitions' sums, one row
    each, give the offsets.
    """
    parts = stored(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "by-range")
    inner = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order))
    sums = parts.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    return parts.withColumn("_inner", inner).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before", "_value")  # a row per partition


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Numbers all rows from 0 in the order of ``order``, which must be unique."""
    return with_running(df, F.lit(1).cast("long"), *order, name=name).withColumn(name, F.col(name) - 1)
