"""Reading prediction, report and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions.text import canonical_id, squeeze
from quarry.operators.align import keep_first


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with quoted line breaks and doubled quotes; ``ingest_ord`` keeps the file order."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("lineSep", "\n").option("nullValue", "\x01")
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path).withColumn("ingest_ord", F.monotonically_increasing_id())


def layout(df: DataFrame) -> tuple[str, str, str]:
    """The id, reference and prediction columns of a known layout."""
    for names in schemas.LAYOUTS:
        if all(n in df.columns for n in names):
            return names
    raise ValueError(f"no known layout among the columns {df.columns}")


def normalised(df: DataFrame, order: str = "ingest_ord") -> DataFrame:
    """``id, gt, pred, <order>``: rows with both texts, canonical ids, the first row of each id."""
    i, g, p = layout(df)
    rows = df.select(F.col(i).alias("id"), F.col(g).alias("gt"), F.col(p).alias("pred"), order)
    rows = rows.dropna(subset=["gt", "pred"]).withColumn("id", canonical_id(F.col("id")))
    return keep_first(rows, ["id"], order)


def labellable(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """First row of each key, then only texts that are not blank: what a label model is run on."""
    return keep_first(df, [key], order).filter(squeeze(F.col(text)) != "")


def training_texts(df: DataFrame) -> DataFrame:
    """``text``: the findings column, else the second one, without nulls."""
    name = "Findings_EN" if "Findings_EN" in df.columns else df.columns[1]
    return df.select(F.col(name).cast("string").alias("text")).dropna()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.METRICS).csv(path)


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, accession, length``: the image files under a folder, without their content."""
    from quarry.functions.text import accession, stem_of

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii.gz").option("recursiveFileLookup", True).load(folder)
    return files.select("path", accession(F.col("path")).alias("accession"), stem_of(F.col("path")).alias("name"), "length")
