"""Label caches: numpy archives and their Parquet form."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import mentions, negated


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``path, volumes, labels`` of archives with the arrays ``labels`` and ``volumes``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                labels = z["labels"].astype(np.int32)
                yield pd.DataFrame({"path": p, "volumes": [str(v) for v in z["volumes"]], "labels": list(labels)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(each, "path string, volumes string, labels array<int>")


def write_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("source", "side").parquet(path)


def lexicon_labels(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, labels``: the default labeller; a condition is set if a sentence names it and is not
    negated."""
    from quarry import lexicon
    from quarry.functions.text import sentences

    each = df.select(key, F.explode_outer(sentences(F.col(text))).alias("s"))
    low = F.lower("s")
    hits = F.when(negated(low), F.array().cast("array<string>")).otherwise(mentions(low))
    got = each.select(key, hits.alias("h")).groupBy(key).agg(F.flatten(F.collect_set("h")).alias("h"))
    return got.select(key, F.array(*(F.array_contains("h", n).cast("int") for n in lexicon.LABELS)).alias("labels"))


def model_labels(df: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], batch: int = 32, threshold: float = 0.5) -> DataFrame:
    """``key, labels`` of any model that turns a list of texts into a matrix of probabilities."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                p = model(part.iloc[:, 1].tolist())
                yield pd.DataFrame({key: part.iloc[:, 0], "labels": list((np.asarray(p) > threshold).astype(np.int32))})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(each, f"`{key}` {kind}, labels array<int>")
