"""Paired bootstrap of score differences.

The draws are a formula of resample and slot, the same on every engine, so no index list leaves the
driver. Scores are joined to the draws by row number and averaged for each resample: exact, but a
shuffle of resamples times rows. For many rows ``poisson_deltas`` weighs every row by a Poisson draw
of its own for each resample instead; it needs no row numbers and no join, and what is shuffled is
one partial sum for each task and resample. Its resamples hold ``n`` rows only on average, which
widens no interval by more than the order of 1 / n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.nlg import STATS, bleu


def draw(seed: int, b: Column, slot: Column, n: Column) -> Column:
    """Row number drawn for a slot of a resample: leading hexadecimal digits of an MD5 hash, modulo ``n``."""
    h = F.substring(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), b.cast("string"), slot.cast("string")).cast("binary")), 1, 8)
    return F.conv(h, 16, 10).cast("long") % n


#: distribution function of a Poisson variable of mean 1, up to the resolution of the hash
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def poisson(seed: int, b: Column, row: Column) -> Column:
    """How often a row is drawn for a resample: a Poisson draw of mean 1 by an MD5 hash."""
    h = F.substring(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), b.cast("string"), row.cast("string")).cast("binary")), 1, 8)
    u = F.conv(h, 16, 10).cast("double") / float(1 << 32)
    w = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        w = F.when(u < POISSON[k], k).otherwise(w)
    return w


def poisson_deltas(rows: DataFrame, resamples: int, key: str, base: str, ours: str, seed: int = 0) -> DataFrame:
    """``b, delta``: difference of the weighted means of two score columns; ``key`` names the rows."""
    d = rows.select(F.col(key).alias("k"), (F.col(ours) - F.col(base)).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    w = d.withColumn("w", poisson(seed, F.col("b"), F.col("k")))
    # a resample that draws no row has no mean
    return w.groupBy("b").agg(F.try_divide(F.sum(F.col("d") * F.col("w")), F.sum("w")).alias("delta"))


def draws(spark, resamples: int, n: int, seed: int = 0) -> DataFrame:
    """``b, row``: ``n`` draws with replacement for each of ``resamples``."""
    at = spark.range(resamples * n).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("slot"))
    return at.select("b", draw(seed, F.col("b"), F.col("slot"), F.lit(n)).alias("row"))


def numpy_draws(spark, resamples: int, n: int, seed: int = 0) -> DataFrame:
    """``b, row`` as numpy's default generator draws them, for comparisons with older results. The
    generator is sequential, so the draws are made on the driver: use it for small ``resamples * n``."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    each = [pd.DataFrame({"b": b, "row": rng.integers(0, n, size=n)}) for b in range(resamples)]
    return spark.createDataFrame(pd.concat(each, ignore_index=True) if each else pd.DataFrame({"b": [], "row": []}), "b long, row long")


def weights(spark, resamples: int, n: int, seed: int = 0) -> DataFrame:
    """``b, row, w``: how often each row is drawn, which is all that sums and means need."""
    return draws(spark, resamples, n, seed).groupBy("b", "row").agg(F.count(F.lit(1)).alias("w"))


def mean_deltas(rows: DataFrame, w: DataFrame, base: str, ours: str) -> DataFrame:
    """``b, delta``: difference of the weighted means of two score columns."""
    j = w.join(rows.select("row", (F.col(ours) - F.col(base)).alias("d")), "row")
    return j.groupBy("b").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("delta"))


def bleu_deltas(rows: DataFrame, w: DataFrame, n: int = 4, base: str = "base_", ours: str = "ours_") -> DataFrame:
    """``b, delta``: difference of corpus BLEU in percent, from weighted sums of row statistics."""
    sums = [F.sum(F.col(p + c) * F.col("w")).alias(p + c) for p in (base, ours) for c in STATS]
    s = w.join(rows, "row").groupBy("b").agg(*sums)
    return s.select("b", ((bleu(n, ours) - bleu(n, base)) * 100).alias("delta"))


def interval(deltas: DataFrame, level: float = 0.95) -> DataFrame:
    """``mean_delta, ci_lower, ci_upper, p_greater, n_ok`` with interpolated percentiles."""
    a = (1 - level) / 2
    return deltas.filter("delta is not null").agg(
        F.avg("delta").alias("mean_delta"),
        F.percentile("delta", F.lit(a)).alias("ci_lower"),
        F.percentile("delta", F.lit(1 - a)).alias("ci_upper"),
        F.avg((F.col("delta") > 0).cast("double")).alias("p_greater"),
        F.count(F.lit(1)).alias("n_ok"),
    )
