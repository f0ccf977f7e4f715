"""Multilabel scores from counts of true and false positives and negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.arrays import f1, precision, ratio, recall
from quarry.functions.text import in_parts


def confusion(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, tp, fp, fn, tn`` of rows with ``gt`` and ``pred`` in {0, 1}."""
    g, p = F.col("gt") == 1, F.col("pred") == 1
    return pairs.groupBy(*by).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")
    )


def scored(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of counts; 0 where undefined."""
    c = counts.withColumn("precision", precision(F.col("tp"), F.col("fp"))).withColumn("recall", recall(F.col("tp"), F.col("fn")))
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def micro_macro(pairs: DataFrame, by: Sequence[str], label: str = "idx") -> DataFrame:
    """``by, micro_precision, micro_recall, micro_f1, macro_f1``: the counts of each label are taken once
    and added up for the micro scores, so the pairs are read and shuffled once."""
    counts = confusion(pairs, [*by, label])
    total = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    macro = F.avg("f1").alias("macro_f1")
    out = scored(counts).groupBy(*by).agg(*total, macro)
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return out.select(*by, p.alias("micro_precision"), r.alias("micro_recall"), f1(p, r).alias("micro_f1"), "macro_f1")


def with_total(pairs: DataFrame, label: str = "idx", total: int = -1) -> DataFrame:
    """Scores of every label and, under ``total``, of all labels together (GROUPING SETS)."""
    g, p = F.col("gt") == 1, F.col("pred") == 1
    sums = pairs.groupingSets([[F.col(label)], []], F.col(label)).agg(
        F.grouping(label).alias("__all"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")
    )
    return scored(sums.withColumn(label, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(label))).drop("__all"))


def weighted(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Support-weighted averages of label scores."""
    s = F.sum("support")
    w = [ratio(F.sum(F.col(c) * F.col("support")), s).alias(c) for c in ("precision", "recall", "f1")]
    return scores.groupBy(*by).agg(*w, s.alias("support"))


def report(pairs: DataFrame, by: Sequence[str], label: str = "idx", row: str = "key") -> DataFrame:
    """Micro, macro, weighted and per-sample averages: ``by, average, precision, recall, f1``."""
    labels = scored(confusion(pairs, [*by, label]))
    micro = scored(labels.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))))
    macro = labels.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    samples = scored(confusion(pairs, [*by, row])).groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    out = None
    for name, df in (("micro", micro), ("macro", macro), ("weighted", weighted(labels, by)), ("samples", samples)):
        part = df.select(*by, F.lit(name).alias("average"), "precision", "recall", "f1")
        out = part if out is None else out.unionByName(part)
    return out


def consistency(pairs: DataFrame) -> DataFrame:
    """``n, tp, fp, fn, precision, recall, f1`` of all cells, in four decimals."""
    c = confusion(pairs, []).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f = 2 * p * r / F.greatest(p + r, F.lit(1e-9))
    return c.select("n", "tp", "fp", "fn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f, 4).alias("f1"))


def text_report(scores: DataFrame, name: str) -> DataFrame:
    """``line``: a fixed-width text line of each row's scores, rounded by their exact values."""
    cells = [in_parts(F.col(c), 100) for c in ("precision", "recall", "f1")]
    shown = [F.format_string("%d.%02d", F.floor(c / 100).cast("long"), (c % 100).cast("long")) for c in cells]
    return scores.select(F.format_string("%-34s %9s %9s %9s %9d", name, *shown, "support").alias("line"))


def wide_labels(df: DataFrame, names: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Label vectors as columns: ``columns`` maps a prefix to the vector column."""
    keep = [c for c in df.columns if c not in columns.values()]
    cells = [F.element_at(v, i + 1).alias(f"{p}_{n}") for p, v in columns.items() for i, n in enumerate(names)]
    return df.select(*keep, *cells)
