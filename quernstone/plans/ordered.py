"""Running sums and places over groups of any size, without sorting a group in one task.

Rows are partitioned by ranges of (group, order) and written once; sums of each group's part of a partition are added up in a table with one row for each
group and partition, and only the rest is summed within the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import materialize


def prefix_sum(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows before each one in its group, 0 for the first; null values add nothing."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread, _ = materialize(df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = spread.groupBy(*groups, "_part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*groups, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = spread.withColumn("_own", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(base, [*groups, "_part"]).withColumn(name, F.col("_base") + F.col("_own")).drop("_part", "_base", "_own")


def place(df: DataFrame, groups: list[str], order: list[str], name: str = "place") -> DataFrame:
    """`df` with the place of each row in its group, from 1."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), groups, order, "_one", name).withColumn(name, F.col(name) + 1).drop("_one")
