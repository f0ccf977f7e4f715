"""Aggregation of several candidate texts of one sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.arrays import cosine
from quarry.functions.text import set_jaccard, tokens
from quarry.plans.durable import sized


#: most candidates of one sample; a generator draws a few dozen
MOST = 4_096


def checked(df: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """``df``, if no sample has more than ``most`` candidates. They are gathered in one row afterwards,
    so this is counted first, on the key alone; too many are an error, never dropped."""
    worst = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if worst > most:
        raise ValueError(f"a sample has {worst} candidates, more than {most}: is {key} the right key?")
    return df


def united(df: DataFrame, key: str, k: str, text: str) -> DataFrame:
    """``key, text``: the candidates in ``k`` order, joined by a blank."""
    df = checked(df, key)
    got = F.sort_array(F.collect_list(F.struct(k, F.coalesce(text, F.lit("")).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(got, lambda x: x["t"]), " ").alias("text"))


def self_consistent(df: DataFrame, key: str, k: str, text: str, n: int = 1) -> DataFrame:
    """``key, text``: the ``n`` candidates most like the others, in that order (ties: lower ``k``).

    The mean similarity to all others is quadratic in the candidates of a sample by its definition;
    their number is checked, and each is compared with the others inside one array. With ``n`` or fewer candidates all are joined in
    ``k`` order; no candidate gives an empty text."""
    df = checked(df, key)
    got = F.sort_array(F.collect_list(F.struct(k, F.coalesce(text, F.lit("")).alias("t"), tokens(F.col(text)).alias("w"))))
    sample = df.groupBy(key).agg(got.alias("c"))
    words = sample.withColumn("c", F.transform("c", lambda x, i: F.struct(i.alias("i"), x["t"].alias("t"), F.array_distinct(x["w"]).alias("w"))))
    total = lambda x: F.aggregate(
        F.col("c"), F.lit(0.0), lambda s, y: s + F.when(y["i"] == x["i"], F.lit(0.0)).otherwise(set_jaccard(x["w"], y["w"]))
    )
    ranked = F.array_sort(F.transform("c", lambda x: F.struct((-total(x) / F.greatest(F.size("c") - 1, F.lit(1))).alias("s"), x["i"].alias("i"), x["t"].alias("t"))))
    best = F.array_join(F.transform(F.slice(ranked, 1, n), lambda x: x["t"]), " ")
    every = F.array_join(F.transform("c", lambda x: x["t"]), " ")
    return words.select(key, F.when(F.size("c") <= n, every).otherwise(best).alias("text"))


def best_scored(df: DataFrame, key: str, k: str, score: str, text: str) -> DataFrame:
    """``key, text``: the candidate of the highest score, the first of equals; null scores lose."""
    order = F.struct(F.col(score).isNotNull().alias("has"), F.col(score).alias("s"), (-F.col(k)).alias("k"))
    best = df.groupBy(key).agg(F.max_by(F.struct(F.col(text).alias("__t")), order).alias("b"))
    return best.select(key, F.col("b.__t").alias(text))


def aggregate(df: DataFrame, key: str, k: str, text: str, score: str | None = None, self_consistent_n: int = 0, union: bool = False) -> DataFrame:
    """One branch, by priority: self-consistency, union, single candidate, re-ranking."""
    if self_consistent_n:
        return self_consistent(df, key, k, text, self_consistent_n)
    if union:
        return united(df, key, k, text)
    if score is None:
        return best_scored(df.withColumn("__s", F.lit(0.0)), key, k, "__s", text)
    return best_scored(df, key, k, score, text)


def alignment_scores(vectors: DataFrame, queries: DataFrame, group: str, vector: str, temperature: float = 1.0) -> DataFrame:
    """Cosine of each vector with the query of its group, over the temperature."""
    q = sized(queries.select(group, F.col(vector).alias("__q")), "queries")
    return vectors.join(q, group).withColumn("score", cosine(F.col(vector), F.col("__q")) / temperature).drop("__q")


def contrastive_loss(sims: DataFrame, row: str, col: str, sim: str) -> DataFrame:
    """``loss``: symmetric cross entropy of matching rows and columns."""
    out = []
    for side in (row, col):
        # the largest of a row is taken off before ``exp``, which overflows above 709
        top = F.max(sim).over(Window.partitionBy(side))
        lse = sims.withColumn("__top", top).groupBy(side).agg((F.max("__top") + F.log(F.sum(F.exp(F.col(sim) - F.col("__top"))))).alias("lse"))
        out.append(lse.agg(F.sum("lse").alias("s"), F.count(F.lit(1)).alias("n")))
    diagonal = sims.filter(F.col(row) == F.col(col)).agg(F.sum(sim).alias("d"))
    a, b = out[0].select(F.col("s").alias("s1"), "n"), out[1].select(F.col("s").alias("s2"))
    return a.join(b).join(diagonal).select(((F.col("s1") + F.col("s2") - 2 * F.col("d")) / (2 * F.col("n"))).alias("loss"))
