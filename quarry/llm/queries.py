"""Queries of the text-corpus operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, leaks, overlaps, pairs, sentences, spam, truncation
from quarry.plans.workers import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.found({
        "predictions": (table(spark, sf_dir, "predictions"), "sample_id", "Pred_combined_report"),
        "region_reports": (table(spark, sf_dir, "region_reports"), "row_id", "Sentence"),
    })


@query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("p6_round_trip", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts decoded from their ids."""
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def _p7_sql(select: str) -> str:
    def grams(key: str, src: str) -> str:
        bare = "regexp_replace(text, '[\\x{00ad}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{feff}]', '', 'g')"
        words = f"regexp_extract_all(replace(lower(strip_accents({bare})), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
        return f"SELECT DISTINCT {key}, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {key}, {words} AS w FROM {src} WHERE text IS NOT NULL))"

    return f"WITH d AS ({grams('doc_id', 'documents')}), i AS ({grams('item_id', 'eval_items')}), found AS (SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)) {select}"


@query("p7_found", _p7_sql("SELECT doc_id, item_id FROM found"))
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p7_proximity")
def p7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query("p7_items", _p7_sql("SELECT e.item_id, e.split, count(f.doc_id) AS n_docs FROM eval_items e LEFT JOIN found f USING (item_id) GROUP BY ALL"))
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return leaks.leaked_items(leaks.passages(table(spark, sf_dir, "documents"), items), items)


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


@query("p8_hosts")
def p8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and spam pages of each host."""
    s = spam.scores(table(spark, sf_dir, "documents"))
    return s.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("smoothed") > 0.5).alias("spam"))


def _split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region_reports").select(F.lit("region_reports").alias("tbl"), F.col("row_id").alias("id"), "split", "source", F.col("Sentence").alias("text"))
    p = table(spark, sf_dir, "predictions").select(F.lit("predictions").alias("tbl"), F.col("sample_id").alias("id"), "split", "source", F.col("GT_combined_report").alias("text"))
    return r.unionByName(p)


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.cross_split_pairs(_split_texts(spark, sf_dir))


@query("p3_report")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_report(_split_texts(spark, sf_dir))


@query("p3_links")
def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every row that is compared."""
    return overlaps.links(_split_texts(spark, sf_dir))


REPORTS = ("Pred_combined_report", "GT_combined_report")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "predictions"), "sample_id", REPORTS)


@query("p5_rates")
def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(table(spark, sf_dir, "predictions"), "sample_id", REPORTS, "source")


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "predictions"))


@query("p1_labels")
def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All retained labels of each row, with their posteriors."""
    return pairs.labels(table(spark, sf_dir, "predictions"))


@query("p1_cutoffs")
def p1_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated cutoff of each label with its precision and recall."""
    return pairs.cutoffs(table(spark, sf_dir, "predictions"))
