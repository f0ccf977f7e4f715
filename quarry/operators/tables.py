"""Comparison tables: winners, bold cells, LaTeX and Markdown rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import lexicon
from quarry.functions.text import metric_cell

METRICS = ("Precision", "Recall", "F1")


def long_metrics(df: DataFrame, source: str = "source", condition: str = "Condition") -> DataFrame:
    """``source, condition, metric, v``; a missing value counts as 0."""
    return df.select(F.col(source).alias("source"), F.col(condition).alias("condition"), *METRICS).unpivot(["source", "condition"], list(METRICS), "metric", "v").withColumn("v", F.coalesce("v", F.lit(0.0)))


def winners(long: DataFrame) -> DataFrame:
    """Adds ``best`` and ``cell``: all sources that reach a positive maximum are bold."""
    w = Window.partitionBy("condition", "metric")
    out = long.withColumn("best", (F.col("v") == F.max("v").over(w)) & (F.col("v") > 0))
    return out.withColumn("cell", metric_cell(F.col("v"), F.col("best")))


def latex_rows(cells: DataFrame, prevalence=lexicon.PREVALENCE) -> DataFrame:
    """``bucket, ord, line``: one table row for each condition, sources in name order, P R F1 each."""
    spark = cells.sparkSession
    dim = spark.createDataFrame([(b, bi * 100 + ci, c, label) for bi, (b, cs) in enumerate(prevalence) for ci, (c, label) in enumerate(cs)], "bucket string, ord int, condition string, label string")
    metric = F.when(F.col("metric") == "Precision", 0).when(F.col("metric") == "Recall", 1).otherwise(2)
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", metric.alias("m"), "cell"))), lambda x: x["cell"]), " & ")
    body = cells.join(F.broadcast(dim), "condition").groupBy("bucket", "ord", "label").agg(row.alias("r"))
    return body.select("bucket", "ord", F.concat("label", F.lit(" & "), "r", F.lit(" \\\\")).alias("line"))


def markdown_row(cells: list) -> F.Column:
    """One Markdown table row of string Columns."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def interval_cells(mean, low, high, p) -> list:
    """``+0.12``, ``[-0.10, +0.30]`` and ``0.950``."""
    return [F.format_string("%+.2f", mean), F.format_string("[%+.2f, %+.2f]", low, high), F.format_string("%.3f", p)]
