"""Consecutive row numbers in a global order without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.durable import cut


def numbered(df: DataFrame, *order, name: str = "row") -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order`` (which should have no ties).

    Rows are range-partitioned and written; each partition is numbered by itself and moved by the
    number of rows before it. Only one count for each partition is gathered."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # one row for each partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, own + F.col("__before")).drop("__part", "__before")
