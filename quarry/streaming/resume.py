"""Incremental, resumable ingestion of candidate files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.log import logger

#: parts of a sink by the hash of the key
BUCKETS = 32


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000) -> None:
    """Append all new rows of the Parquet files under ``source`` to the table ``sink``, once for each key.

    The file source remembers in ``checkpoint`` which files it has seen. A batch that is run again
    after a failure overwrites its own partitions, so nothing is written twice; keys of earlier
    batches are kept out by an anti-join with the key column of those buckets of the sink that the
    batch falls into. Of rows with one key the least is kept, column by column. Runs until no new
    files are left."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def each(batch: DataFrame, n: int) -> None:
        first = batch.groupBy(key).agg(F.min(F.struct(*(c for c in batch.columns if c != key))).alias("__r"))
        rows = first.select(key, "__r.*").select(*batch.columns).withColumn("bucket", bucket)
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if there:
            done = spark.read.parquet(sink)
            if "batch" in done.columns:
                touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
                rows = rows.join(done.filter((done["batch"] != n) & done["bucket"].isin(touched)).select(key), key, "left_anti")
        out = transform(rows) if transform else rows
        logger(__name__).info("batch %d goes to %s", n, sink)
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(source)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``window_start, <by>, n`` of a stream or table; a stream drops what is later than ``late``."""
    got = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("window_start"), by, "n")
