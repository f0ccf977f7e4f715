"""Where models enter: generation, scoring, tokenizing. Each takes a plain function on lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from quarry.config import DEFAULT


def schedule(k: int, band: str = "default") -> list[float]:
    """Temperatures of ``k`` samplings."""
    low, high = DEFAULT.bands[band]
    return [low + (high - low) * i / max(k - 1, 1) for i in range(k)]


def generated(samples: DataFrame, key: str, prompt: str, generate: Callable[[list[str], float], list[str]], temperatures: Sequence[float]) -> DataFrame:
    """``key, k, temperature, text``: one candidate for each sample and temperature."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in enumerate(temperatures):
                texts = generate(b.iloc[:, 1].fillna("").tolist(), t)
                if len(texts) != len(b):
                    raise ValueError(f"{len(texts)} texts for {len(b)} samples")
                yield pd.DataFrame({key: b.iloc[:, 0], "k": k, "temperature": t, "text": texts})

    kind = dict(samples.dtypes)[key]
    return samples.select(key, prompt).mapInPandas(each, f"`{key}` {kind}, k int, temperature double, text string")


def scored(candidates: DataFrame, text: str, score: Callable[[list[str]], Sequence[float]], name: str = "score") -> DataFrame:
    """Adds the score that a model gives each text; null texts get null."""
    columns = [*candidates.columns, name]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = b[text].notna()
            b[name] = pd.Series([None] * len(b), dtype="float64", index=b.index)
            if known.any():
                b.loc[known, name] = [float(x) for x in score(b.loc[known, text].tolist())]
            yield b[columns]

    schema = ", ".join(f"`{c}` {t}" for c, t in candidates.dtypes)
    return candidates.mapInPandas(each, f"{schema}, `{name}` double")


def tokenized(df: DataFrame, key: str, text: str, encode: Callable[[str], list[int]], longest: int = 512, pad: int = 0) -> DataFrame:
    """``key, ids, mask``: token ids cut and padded to ``longest``, as a classifier takes them. A null
    text is encoded as one blank."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [encode(" " if t is None else t)[:longest] for t in b.iloc[:, 1]]
            yield pd.DataFrame({key: b.iloc[:, 0], "ids": [x + [pad] * (longest - len(x)) for x in ids], "mask": [[1] * len(x) + [0] * (longest - len(x)) for x in ids]})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(each, f"`{key}` {kind}, ids array<int>, mask array<int>")
