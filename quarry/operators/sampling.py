"""Seeded sampling, shuffling and partition assignment."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.number import numbered


def assigned(df: DataFrame, order: str, workers: int) -> DataFrame:
    """Adds ``worker``: disjoint round-robin assignment in the order of a column."""
    return numbered(df, order).withColumn("worker", F.col("row") % workers).drop("row")


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds ``place``: a permutation that changes with the epoch and not with the partitioning."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed + epoch)), F.col(key).cast("string")).cast("binary"))
    return numbered(df.withColumn("__h", h), "__h", key, name="place").drop("__h")


def buffered_shuffle(df: DataFrame, size: int = 100, seed: int = 0) -> DataFrame:
    """The rows of each partition through a shuffle buffer: once it is full, a random one of its rows
    leaves for each that comes, and at the end the rest leaves in random order."""
    columns = df.columns

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng, buffer = random.Random(seed), []
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                buffer.append(row)
                if len(buffer) > size:
                    i = rng.randrange(len(buffer))
                    buffer[i], buffer[-1] = buffer[-1], buffer[i]
                    out.append(buffer.pop())
            yield pd.DataFrame(out, columns=columns)
        rng.shuffle(buffer)
        yield pd.DataFrame(buffer, columns=columns)

    return df.mapInPandas(each, df.schema)


def top_random(df: DataFrame, group: str, keep: int, seed: int, order: str) -> DataFrame:
    """``keep`` random rows of each group, the same for the same seed. Each of 64 parts of a group is
    cut to ``keep`` rows before the parts meet, so no task sorts a whole group."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(order).cast("string")).cast("binary"))
    df = df.withColumn("__h", h).withColumn("__p", F.pmod(F.xxhash64(order), F.lit(64)))
    for by in ([group, "__p"], [group]):
        df = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h", order))).filter(F.col("__r") <= keep)
    return df.drop("__r", "__h", "__p")
