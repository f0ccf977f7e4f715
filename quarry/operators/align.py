"""Deduplication and alignment of sources by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.number import numbered


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in ingest order (``dropDuplicates`` promises no order).

    An aggregate with partial results on both sides of the shuffle, so a hot key costs one row a
    task instead of a sorted window partition."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row"))
    return first.select(*keys, "__row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return last.select(*keys, "__row.*").select(*df.columns)


def in_all(df: DataFrame, key: str, source: str, n: int) -> DataFrame:
    """Keys that occur in ``n`` different sources."""
    return df.groupBy(key).agg(F.countDistinct(source).alias("__n")).filter(F.col("__n") == n).select(key)


def common_rows(df: DataFrame, key: str, source: str, n: int) -> DataFrame:
    """Rows whose key occurs in all of ``n`` sources."""
    return df.join(in_all(df, key, source, n), key, "left_semi")


def gather(order: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` brought to the keys of ``order``; missing ones are null."""
    return order.join(rows, key, "left")


def paired(base: DataFrame, ours: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join with ``_base`` and ``_ours`` columns and a dense row number in base order."""
    b = base.select(key, *(F.col(c).alias(f"{c}_base") for c in base.columns if c != key))
    o = ours.select(key, *(F.col(c).alias(f"{c}_ours") for c in ours.columns if c != key))
    return numbered(b.join(o, key), f"{order}_base")


def proposer(labels: DataFrame, texts: DataFrame, key: str, order: str) -> DataFrame:
    """Labels with the first text of each key, in label order; keys without a text keep null."""
    return gather(labels, keep_first(texts, [key], order).drop(order), key)


def pending(samples: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Samples not processed yet."""
    return samples.join(done.select(key).distinct(), key, "left_anti")


def reported(samples: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Samples that have a report."""
    return samples.join(reports.select(key).distinct(), key, "left_semi")


def best_key_rewrite(have: DataFrame, want: DataFrame, strategies: dict) -> DataFrame:
    """``strategy, matched``: of several rewritings of the keys in ``have``, the one that meets most
    keys of ``want``; the first named wins ties. ``strategies``: name -> function of a Column."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("strategy"), f(F.col("key")).alias("key")) for i, (n, f) in enumerate(strategies.items()))))
    keys = have.select(each.alias("x")).select("x.*").distinct()
    hits = keys.join(want.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    counts = hits.groupBy("i", "strategy").agg(F.count("hit").alias("matched"))
    return counts.orderBy(F.desc("matched"), "i").limit(1).select("strategy", "matched")
