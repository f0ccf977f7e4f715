"""Batches of region masks and intensity arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import lexicon
from quarry.plans.durable import cut


def collated(df: DataFrame, batch: str, sample: str, tensors: str, size: int, regions: Sequence[str] = lexicon.REGIONS) -> DataFrame:
    """``batch, sample, region, values``: every region that some sample of the batch has, with zeros for
    the samples without it; regions that no sample has are dropped. ``tensors`` maps regions to
    arrays of ``size`` numbers."""
    has = [F.bool_or(F.coalesce(F.map_contains_key(tensors, F.lit(r)), F.lit(False))).over(Window.partitionBy(batch)) for r in regions]
    present = F.filter(F.array(*(F.when(h, F.lit(r)) for h, r in zip(has, regions))), lambda r: r.isNotNull())
    zeros = F.array_repeat(F.lit(0.0), size)
    each = df.withColumn("__p", present).select(batch, sample, tensors, F.explode("__p").alias("region"))
    return each.select(batch, sample, "region", F.coalesce(F.element_at(tensors, F.col("region")), zeros).alias("values"))


def running_count(df: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """Adds ``seen``: how many flagged rows of the group there are up to and including each row."""
    ranged = cut(df.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()), "ranged")
    n = F.sum(F.col(flag).cast("int"))
    # a group of any size is counted in parts; each is moved by the counts of the parts before it
    sums = ranged.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(n.alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__g", "__p", before.alias("__before"))
    own = n.over(Window.partitionBy("__part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = ranged.withColumn("__own", own).join(sums, (F.col("__p") == F.col("__part")) & F.col("__g").eqNullSafe(F.col(group)))
    return counted.withColumn("seen", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before", "__g", "__p")


def running_counts(mask: Column) -> Column:
    """The running sums of an array."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["n"] + x.cast("int")).alias("n"), F.array_append(a["out"], a["n"] + x.cast("int")).alias("out"))
    return F.aggregate(mask, start, step, lambda a: a["out"])


def seeded(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on some values: leading hexadecimal digits of an MD5 hash."""
    h = F.md5(F.concat_ws("-", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def augmented(values: Column, key: Column, seed: int, scale: float = 0.1, shift: float = 0.05, noise: float = 0.01) -> Column:
    """Intensity scale and shift, noise and a flip, all fixed by seed and key."""
    u = lambda name, *more: seeded(F.lit(f"{seed}-{name}"), key, *more)
    moved = F.transform(values, lambda x, i: x * (1 + scale * (2 * u("scale") - 1)) + shift * (2 * u("shift") - 1) + noise * (2 * u("noise", i) - 1))
    return F.when(u("flip") < 0.5, F.reverse(moved)).otherwise(moved)


def foreground(mask: Column) -> Column:
    """First and last place of a mask that is set, or null."""
    places = F.filter(F.transform(mask, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, F.struct(F.array_min(places).alias("first"), F.array_max(places).alias("last")))


def resized(values: Column, length: int) -> Column:
    """Nearest-neighbour resampling to ``length``."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(values, F.floor((i + 0.5) * F.size(values) / length).cast("int")))


def decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray], path: str = "path", content: str = "content") -> DataFrame:
    """``path, shape, values``: image files through a decoder (none is installed here)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arrays = [np.asarray(decode(c), dtype=np.float32) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "shape": [list(a.shape) for a in arrays], "values": [a.ravel() for a in arrays]})

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(each, "path string, shape array<int>, values array<float>")
