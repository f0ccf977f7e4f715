"""Writing results: CSV, JSON, text, Markdown, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """CSV that :func:`quarry.sources.predictions.read_csv` reads back as it was; null is an empty cell,
    empty text is ``""``."""
    out = df.coalesce(1) if one_file else df
    out.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"').option("emptyValue", '""').option("nullValue", "").option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    write_csv(df, path, mode="append")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def summary_json(df: DataFrame) -> DataFrame:
    """``json``: every row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_text(df: DataFrame, line: str, path: str) -> None:
    df.select(F.col(line).cast("string").alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame) -> DataFrame:
    """``line``: a Markdown row of each row's cells."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    return df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
