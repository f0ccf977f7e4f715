"""Cutting lineage in a way that survives the loss of executors.

``cut`` writes a DataFrame as a Parquet table into the folder that the cluster names in
``spark.checkpoint.dir`` (shared by all executors) and reads it back. A table is smaller than a
reliable RDD checkpoint because Parquet is columnar and compressed. Only where the setting is
absent in local mode a temporary folder is used, and the setting is made for the session; a cluster
without the setting is an error, since each executor would write to a disk of its own.

Tables live until the process ends, as a DataFrame that reads them may be used at any time, or until
the end of the innermost ``scope``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set to a fresh local one if none is named in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass  # the session is gone already; the cluster owner clears the shared folder


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are removed at the end, so results must be used or stored before."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _remove(spark, path)


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a table in the shared folder; the plan behind it is not run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: most rows that are sent to all executors
SENT = 100_000


def sized(df: DataFrame, name: str = "side", limit: int = SENT) -> DataFrame:
    """``df`` as a table, marked for broadcast if it has at most ``limit`` rows; a larger one is left
    to a shuffle join."""
    from pyspark.sql import functions as F

    table = cut(df, name)
    return F.broadcast(table) if table.count() <= limit else table
