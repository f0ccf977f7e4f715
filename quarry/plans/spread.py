"""Input in enough partitions for the Python stages that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores.

    A small table may be one file with one row group and would keep one core busy; it is dealt out.
    A scan that fills the cores, as every large one does, is left as it is, without a shuffle. Only
    for plans without an exchange: counting partitions would run those."""
    want = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= want else scan.repartition(want)
