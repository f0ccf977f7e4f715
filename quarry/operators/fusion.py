"""Fusion of label vectors of several sources, for a whole catalogue of fusions in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import lexicon

MODES = ("or", "and", "majority")


def modes(sources: int) -> list[str]:
    """``or`` always, ``majority`` from three sources on, ``and`` for two."""
    return ["or"] + (["majority"] if sources >= 3 else []) + (["and"] if sources == 2 else [])


def long_labels(df: DataFrame, key: str, source: str, labels: str) -> DataFrame:
    """``source, key, idx, label``: one row for each label of a vector."""
    return df.select(F.col(source).alias("source"), F.col(key).alias("key"), F.posexplode(labels).alias("idx", "label"))


def catalogue(spark, fusions: Mapping[str, Sequence[str]]) -> DataFrame:
    """``fusion, ordinal, source, members``."""
    rows = [(f, i, s, len(ss)) for f, ss in fusions.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "fusion string, ordinal int, source string, members int")


def fuse(vectors: DataFrame, cat: DataFrame, width: int = len(lexicon.LABELS)) -> DataFrame:
    """``fusion, mode, key, labels``: element-wise OR, AND and majority over the sources of a fusion,
    for keys that all of its sources have.

    ``vectors``: ``source, key, labels`` with one row for each source and key and ``width`` labels of 0
    or 1. Every element is a sum of its own in one aggregate, so the vectors are neither exploded nor
    put together again, and one row for each fusion and key is shuffled. The catalogue is code, a few
    dozen rows, and is broadcast."""
    joined = vectors.join(F.broadcast(cat), "source")
    sums = [F.sum(F.get("labels", F.lit(i))).alias(f"__{i}") for i in range(width)]
    got = joined.groupBy("fusion", "members", "key").agg(F.count(F.lit(1)).alias("have"), *sums).filter("have = members")
    wide = got.select("fusion", "members", "key", F.array(*(f"__{i}" for i in range(width))).alias("s"))
    m = F.col("members")
    by_mode = F.explode(F.array(
        F.struct(F.lit("or").alias("mode"), F.expr("transform(s, n -> cast(n > 0 as int))").alias("labels"), F.lit(True).alias("on")),
        F.struct(F.lit("and").alias("mode"), F.expr("transform(s, n -> cast(n = members as int))").alias("labels"), (m == 2).alias("on")),
        F.struct(F.lit("majority").alias("mode"), F.expr("transform(s, n -> cast(n > members / 2.0 as int))").alias("labels"), (m >= 3).alias("on")),
    ))
    return wide.select("fusion", "key", by_mode.alias("x")).filter("x.on").select("fusion", "x.mode", "key", "x.labels")


def pairs_with_truth(fused: DataFrame, truth: DataFrame) -> DataFrame:
    """Fused and reference labels of keys that both have, one row for each label."""
    j = fused.join(truth.select("key", F.col("labels").alias("gt")), "key")
    z = F.posexplode(F.arrays_zip(F.col("gt"), F.col("labels").alias("pred"))).alias("idx", "z")
    return j.select("fusion", "mode", "key", z).select("fusion", "mode", "key", "idx", F.col("z.gt").alias("gt"), F.col("z.pred").alias("pred"))


def summary(scores: DataFrame, cat: DataFrame) -> DataFrame:
    """``fusion, mode, cell``: micro F1 with four decimals, ``FAILED`` for fusions without common keys."""
    named = cat.select("fusion", "members").distinct()
    each = F.explode(F.filter(F.array(
        F.when(F.lit(True), F.lit("or")), F.when(F.col("members") >= 3, F.lit("majority")), F.when(F.col("members") == 2, F.lit("and"))
    ), lambda x: x.isNotNull()))
    plan = named.select("fusion", each.alias("mode"))
    return plan.join(scores, ["fusion", "mode"], "left").select("fusion", "mode", F.when(F.col("micro_f1").isNotNull(), F.format_string("%.4f", F.bround("micro_f1", 4))).otherwise("FAILED").alias("cell"))
