"""How often given phrases, exactly or nearly, stand in a corpus."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import plain_sentences, tokens


def sentence_counts(texts: DataFrame, text: str, order: str) -> DataFrame:
    """``sentence, n, first``: distinct lower-case sentences with their frequency and first place.

    Counting before any comparison shrinks the rest of the audit to distinct sentences."""
    each = texts.filter(F.col(text).isNotNull()).select(F.col(order).alias("o"), F.posexplode(plain_sentences(F.col(text).cast("string"))).alias("p", "s"))
    return each.groupBy(F.lower("s").alias("sentence")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first"))


def most_frequent(counts: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent sentences; equals in order of first occurrence."""
    return counts.orderBy(F.desc("n"), "first").limit(k).select("sentence", "n")


def phrase_audit(counts: DataFrame, phrases: Mapping[str, str], similar: float = 0.6, accept: int = 100) -> DataFrame:
    """``region, phrase, exact, fuzzy, status``. A phrase equal to a sentence also counts as similar.

    The phrases are literals with two sums each in one aggregate, so every sentence is compared in one
    pass, without a join or a row for each phrase. Sentences too short or too long to be similar are
    told by their size."""
    words = F.array_distinct(tokens(F.col("sentence")))
    sums = []
    for i, phrase in enumerate(phrases.values()):
        p = F.array_distinct(tokens(F.lit(phrase)))
        common = F.size(F.array_intersect(p, F.col("w")))
        fits = (F.size("w") > 0) & (F.size("w") >= similar * F.size(p)) & (similar * F.size("w") <= F.size(p))
        near = F.when(fits & (common / (F.size(p) + F.size("w") - common) >= similar), F.col("n")).otherwise(0)
        exact = F.when(F.col("sentence") == phrase.lower(), F.col("n")).otherwise(0)
        sums += [F.sum(exact).alias(f"exact{i}"), F.sum(near).alias(f"fuzzy{i}")]
    total = counts.select("sentence", "n", words.alias("w")).agg(F.count(F.lit(1)).alias("rows"), *sums).filter("rows > 0")
    each = [F.struct(F.lit(r).alias("region"), F.lit(p).alias("phrase"), F.col(f"exact{i}").alias("exact"), F.col(f"fuzzy{i}").alias("fuzzy")) for i, (r, p) in enumerate(phrases.items())]
    out = total.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return out.withColumn("status", F.when(F.col("exact") + F.col("fuzzy") >= accept, "VALIDATED").otherwise("LOW-FREQUENCY"))
