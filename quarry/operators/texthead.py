"""A deterministic extractive report from several texts and fused labels.

Sentences are matched to conditions by patterns inside a projection, agreement between texts comes
from an equi-join on word 5-grams within a volume, and the greedy choice with deduplication across
conditions is a fold over one ordered array for each volume.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import lexicon
from quarry.config import DEFAULT, Config
from quarry.functions import text as T
from quarry.plans.durable import cut


def candidates(df: DataFrame, synonyms: Mapping[str, Sequence[str]] = lexicon.SYNONYMS) -> DataFrame:
    """``volume, p_idx, s_idx, sent, words, pos, neg`` of ``volume, p_idx, text``."""
    each = df.select("volume", "p_idx", F.posexplode(T.sentences(F.col("text"))).alias("s_idx", "sent"))
    low = F.lower("sent")
    named = each.withColumn("neg?", T.negated(low)).withColumn("hit", T.mentions(low, synonyms))
    none = F.array().cast("array<string>")
    return named.select(
        "volume", "p_idx", "s_idx", "sent", T.tokens(F.col("sent")).alias("words"),
        F.when(F.col("neg?"), none).otherwise(F.col("hit")).alias("pos"), F.when(F.col("neg?"), F.col("hit")).otherwise(none).alias("neg"),
    )


def agreement(cands: DataFrame, n: int = 5, at: float = 0.4) -> DataFrame:
    """``volume, p_idx, s_idx, agreement``: how many other texts of the volume have a sentence with a
    word ``n``-gram similarity of ``at`` or more. Such a pair shares at least one n-gram, so the
    equi-join finds every one; sentences without a partner are not listed. N-grams are compared by
    64-bit hashes within a volume, and those of one text only are dropped before the join."""
    grams = cands.select("volume", "p_idx", "s_idx", F.array_distinct(T.ngrams(F.col("words"), n)).alias("g")).filter(F.size("g") > 0)
    flat = grams.select("volume", "p_idx", "s_idx", F.size("g").alias("m"), F.explode(F.transform("g", lambda g: F.xxhash64(g))).alias("gram"))
    # one shuffle serves the count of texts and both sides of the join
    flat = cut(flat.repartition("volume", "gram"), "grams").repartition("volume", "gram")
    shared = flat.groupBy("volume", "gram").agg(F.min("p_idx").alias("lo"), F.max("p_idx").alias("hi")).filter("lo <> hi").select("volume", "gram")
    flat = flat.join(shared, ["volume", "gram"], "left_semi")
    other = flat.select("volume", "gram", F.col("p_idx").alias("p2"), F.col("s_idx").alias("s2"), F.col("m").alias("m2"))
    both = flat.join(other, ["volume", "gram"]).filter(F.col("p_idx") != F.col("p2"))
    common = both.groupBy("volume", "p_idx", "s_idx", "p2", "s2", "m", "m2").agg(F.count(F.lit(1)).alias("c"))
    near = common.filter(F.col("c") / (F.col("m") + F.col("m2") - F.col("c")) >= at)
    return near.groupBy("volume", "p_idx", "s_idx").agg(F.countDistinct("p2").cast("int").alias("agreement"))


def scored(cands: DataFrame, agree: DataFrame, fused: DataFrame, names: Sequence[str] = lexicon.LABELS, cfg: Config = DEFAULT) -> DataFrame:
    """Candidates with ``labels``, ``agreement``, ``n_poll`` and ``score``."""
    j = cands.join(agree, ["volume", "p_idx", "s_idx"], "left").join(fused.select("volume", "labels"), "volume")
    all_names = F.array(*(F.lit(n) for n in names))
    wrong = F.size(F.filter("pos", lambda c: F.element_at(F.col("labels"), F.array_position(all_names, c).cast("int")) == 0))
    low = F.lower("sent")
    j = j.withColumn("agreement", F.coalesce("agreement", F.lit(0))).withColumn("n_poll", wrong)
    score = F.when(T.measured(low), cfg.weight_measure).otherwise(0.0)
    score = score + cfg.weight_place * F.least(T.places(low), F.lit(cfg.most_places))
    score = score + cfg.weight_word * F.least(F.size("words"), F.lit(cfg.most_words))
    score = score + cfg.weight_agree * F.col("agreement")
    return j.withColumn("score", score - cfg.weight_pollution * F.col("n_poll"))


def report(cands: DataFrame, fused: DataFrame, names: Sequence[str] = lexicon.LABELS, region: Mapping[str, str] = lexicon.REGION, regions: Sequence[str] = lexicon.REGIONS, stock: Mapping[str, Sequence[str]] = lexicon.STOCK, cfg: Config = DEFAULT) -> DataFrame:
    """``volume, report`` for every volume of ``fused`` (``volume, labels``), with or without candidates."""
    all_names = F.array(*(F.lit(n) for n in names))
    fit = F.filter(
        F.transform(all_names, lambda n, i: F.struct(i.alias("c"), F.array_contains(F.when(F.element_at(F.col("labels"), (i + 1).cast("int")) == 1, F.col("pos")).otherwise(F.col("neg")), n).alias("ok"))),
        lambda x: x["ok"],
    )
    rows = cands.select("volume", F.explode(fit).alias("x"), "score", "p_idx", "s_idx", "sent", T.dedup_prefix(F.col("sent"), cfg.prefix).alias("prefix"))
    line = T.finished(T.shortened(F.col("sent"), cfg.longest_sentence))
    item = F.struct(F.col("x.c").alias("c"), (-F.col("score")).alias("o"), "p_idx", "s_idx", "prefix", line.alias("line"))
    ordered = rows.groupBy("volume").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.expr("named_struct('seen', cast(array() as array<string>), 'c', -1, 'n', 0, 'picks', cast(array() as array<struct<c:int,line:string>>))")

    def step(a, x):
        n = F.when(a["c"] == x["c"], a["n"]).otherwise(0)
        take = (n < cfg.top_k) & ~F.array_contains(a["seen"], x["prefix"])
        return F.struct(
            F.when(take, F.array_append(a["seen"], x["prefix"])).otherwise(a["seen"]).alias("seen"),
            x["c"].alias("c"),
            F.when(take, n + 1).otherwise(n).alias("n"),
            F.when(take, F.array_append(a["picks"], F.struct(x["c"].alias("c"), x["line"].alias("line")))).otherwise(a["picks"]).alias("picks"),
        )

    picks = ordered.select("volume", F.aggregate("items", start, step, lambda a: a["picks"]).alias("picks"))
    j = fused.select("volume", "labels").join(picks, "volume", "left")
    j = j.withColumn("picks", F.coalesce("picks", F.expr("cast(array() as array<struct<c:int,line:string>>)")))

    def picked(i: int):  # a lambda with a second parameter would be given the position of the element
        return F.transform(F.filter("picks", lambda p: p["c"] == i), lambda p: p["line"])

    parts = []
    for r in regions:
        lines = []
        for i, n in enumerate(names):
            if region[n] == r:
                got = picked(i)
                none = F.when(F.element_at("labels", i + 1) == 1, F.lit(f"{n} was detected.")).otherwise(F.lit(f"{n} was not detected."))
                lines.append(F.when(F.size(got) > 0, got).otherwise(F.array(none)))
        lines += [F.array(F.lit(s)) for s in stock.get(r, ())]
        body = F.array_join(F.concat(*lines), " ") if lines else F.lit("")
        parts.append(F.struct(F.lit(r).alias("region"), body.alias("body")))
    full = F.filter(F.array(*parts), lambda p: p["body"] != "")
    return j.select("volume", F.array_join(F.transform(full, lambda p, i: T.region_sentence(i, p["region"], p["body"])), " ").alias("report"))


def build(texts: DataFrame, fused: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``volume, report`` from ``volume, p_idx, text`` and ``volume, labels``. The sentences with their
    matches and the labels are written once; both sides of the agreement join and the scores read them."""
    c, fused = cut(candidates(texts), "sentences"), cut(fused.select("volume", "labels"), "labels")
    return report(scored(c, agreement(c, cfg.agree_ngram, cfg.agree_at), fused, cfg=cfg), fused, cfg=cfg)
