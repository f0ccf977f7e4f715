"""Region reports of volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import lexicon
from quarry.functions.arrays import by_hash
from quarry.functions.text import canonical_id, region_sentence


def region_name(c: Column) -> Column:
    """Trimmed lower-case region, ``whole`` where none is given."""
    return F.coalesce(F.lower(F.trim(c)), F.lit("whole"))


def latest(df: DataFrame, volume: str = "Volumename", region: str = "Anatomy", text: str = "Sentence", order: str = "row_id") -> DataFrame:
    """``volume, region, text``: the last sentence given for each volume and region."""
    rows = df.select(canonical_id(F.col(volume)).alias("volume"), region_name(F.col(region)).alias("region"), F.col(text).alias("text"), F.col(order).alias("o"))
    # max_by skips no nulls here: the struct is never null, so a last null text wins as well
    return rows.groupBy("volume", "region").agg(F.max(F.struct("o", "text"))["text"].alias("text"))


def maps(latest_rows: DataFrame) -> DataFrame:
    """``volume, regions``: a map for each volume."""
    return latest_rows.groupBy("volume").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("region", "text")))).alias("regions"))


def with_every_region(latest_rows: DataFrame, regions: Sequence[str] = lexicon.REGIONS, keep_missing: bool = True) -> DataFrame:
    """``volume, region, text`` for every region of the list: an empty text where none is reported,
    or only the reported ones."""
    if not keep_missing:
        return latest_rows.filter(F.col("region").isin(*regions)).filter("text is not null")
    got = latest_rows.groupBy("volume").agg(F.map_from_entries(F.collect_list(F.struct("region", "text"))).alias("m"))
    each = F.explode(F.array(*(F.lit(r) for r in regions))).alias("region")
    return got.select("volume", "m", each).select("volume", "region", F.coalesce(F.element_at("m", F.col("region")), F.lit("")).alias("text"))


def combined(latest_rows: DataFrame, regions: Sequence[str] = lexicon.REGIONS) -> DataFrame:
    """``volume, report``: the regions with text, numbered in the order of the list, a blank after each."""
    rank = F.array_position(F.array(*(F.lit(r) for r in regions)), F.col("region"))
    rows = latest_rows.filter(F.col("region").isin(*regions) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    got = rows.groupBy("volume").agg(F.sort_array(F.collect_list(F.struct(rank.alias("k"), "region", "text"))).alias("r"))
    return got.select("volume", F.array_join(F.transform("r", lambda x, i: F.concat(region_sentence(i, x["region"], x["text"]), F.lit(" "))), "").alias("report"))


def present_only(regions: Column, masks: Column) -> Column:
    """The entries of one map whose keys the other has."""
    return F.map_filter(regions, lambda k, v: F.map_contains_key(masks, k))


def shuffled(names: Column, key: Column, seed: int) -> Column:
    """The names in an order fixed by seed and key, as training takes them."""
    return by_hash(names, lambda x, i: F.concat_ws("-", F.lit(str(seed)), key.cast("string"), x))


def numbered(names: Column) -> Column:
    """A map from position to region name."""
    return F.map_from_entries(F.transform(names, lambda x, i: F.struct(i, x)))
