"""Differences between two copies of a table, cell by cell.

Both sides are unpivoted to key-field-digest rows that carry a sign, united, and grouped: what
cancels is equal. Only 16-byte digests are shuffled, never the values. Cells that do not cancel
(few) fetch their values once more and are compared after Unicode composition, which has no
JVM-side function; those that cancel then are equal as well.

Defined results
    * null, empty and white-space-only values are one value; so are two texts that differ in kind
      or amount of white space or in Unicode composition; letter case is a difference
    * a key sent several times on a side counts once for every distinct value; a key with several
      values on a side differs unless the other side has the same set
    * null keys on both sides form one key
    * empty tables: every key of the other side is ``only_in_...``
    * columns other than the key and the compared fields are ignored, whatever their names
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.text import canonical_id

#: white space of any kind, the separators of Unicode included
SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
_ROW = "__row__"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACE, " "))


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x.isascii() else " ".join(unicodedata.normalize("NFC", x).split()))


def _cells(df: DataFrame, key: str, values: Mapping[str, Column], sign: int) -> DataFrame:
    cells = F.array(
        F.struct(F.lit(_ROW).alias("field"), F.lit("").alias("v")),
        *(F.struct(F.lit(f).alias("field"), c.alias("v")) for f, c in values.items()),
    )
    return df.select(F.col(key).alias("k"), F.explode(cells).alias("c")).select("k", "c.field", "c.v", F.lit(sign).alias("sign"))


def _open(cells: DataFrame) -> DataFrame:
    """Distinct digests by cell that one side only has."""
    g = cells.groupBy("k", "field", "d").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
    return g.filter("hi + lo <> 0")


def differences(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: Sequence[str],
    *,
    id_fields: Sequence[str] = (),
    only_left: str = "only_in_left",
    only_right: str = "only_in_right",
) -> DataFrame:
    """Rows ``(<key>, diff)``: ``only_left``/``only_right`` for a key on one side, else one row for
    each of ``fields`` that differs. ``id_fields`` are compared as canonical volume ids."""

    def values(df: DataFrame) -> dict[str, Column]:
        return {f: canonical_id(squeezed(df[f])) if f in id_fields else squeezed(df[f]) for f in fields}

    def digest(cells: DataFrame) -> DataFrame:
        return cells.select("k", "field", "sign", F.unhex(F.md5(F.col("v").cast("binary"))).alias("d"))

    sides = [_cells(left, key, values(left), 1), _cells(right, key, values(right), -1)]
    rough = _open(digest(sides[0]).unionByName(digest(sides[1])))
    lone = rough.filter(F.col("field") == _ROW).select("k", F.when(F.col("hi") > 0, F.lit(only_left)).otherwise(F.lit(only_right)).alias("diff"))

    keys = rough.filter(F.col("field") != _ROW).select("k", "field").distinct()
    again = [
        _cells(df.join(keys.select(F.col("k").alias("__k")).distinct(), df[key].eqNullSafe(F.col("__k")), "left_semi"), key, values(df), s)
        for df, s in ((left, 1), (right, -1))
    ]
    fine = again[0].unionByName(again[1]).filter(F.col("field") != _ROW).withColumn("v", _composed("v"))
    differing = _open(digest(fine)).select("k", "field").distinct()
    pairs = differing.join(lone.select(F.col("k").alias("__k")), F.col("k").eqNullSafe(F.col("__k")), "left_anti")
    return lone.unionByName(pairs.withColumnRenamed("field", "diff")).select(F.col("k").alias(key), "diff")


def difference_counts(diffs: DataFrame) -> DataFrame:
    """How often each kind of difference occurs: ``diff, n``."""
    return diffs.groupBy("diff").agg(F.count(F.lit(1)).alias("n"))
