"""Same or near-same records across splits.

Every text gets a fingerprint of its word sequence and minwise hashes of its word shingles, in
bands. Rows of one fingerprint form a class, so that copies are sketched, joined and compared once.
Only bands shared by a training class and an evaluation class make candidates. Bands are joined
within ranges of length, so that a band with many classes falls into parts; classes whose lengths
rule out the distance never meet. Texts of one template share bands by chance, in numbers that grow
with the square of the corpus. The join itself tells them apart by parities of their word counts: an
edit changes at most two of these, so no pair within the distance is lost. The candidates left are
verified by exact Jaccard similarity of their shingles and then by exact word edit distance.

A pair that differs in at most 8 % of the longer text's words keeps a shingle similarity of about
0.6 or more at three words a shingle in the worst case (every edit in shingles of its own); 32
bands of 4 rows find 99 % of such worst cases and practically all others. Shingles are numbered by
occurrence, so this holds for texts of repeated sentences, too.

The links are between classes; ``links`` counts them for each row and ``overlap_report`` for each
split and source without expanding them. ``cross_split_pairs`` expands them to pairs of rows.

Defined results
    * null, empty and short texts (under ``LEAST`` words) and rows of other splits are in no pair
    * every pair of rows comes out once, ``id_a < id_b``; repeated ids count once
    * extra columns are ignored
    * classes with many rows are expanded in salted parts of either side, so no task holds a whole class
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quarry.llm import nearcopies as nc
from quarry.plans.durable import cut
from quarry.plans.spread import spread

LEAST = 32
SHARE = 0.08
SHINGLE, BANDS, ROWS = 3, 32, 4
#: least shingle similarity of a pair within the allowed distance, with a margin
SIMILAR = 0.5
#: rows of a class that one salted part holds
PART = 2_000
#: width of a range of lengths, as a multiple of the difference that the distance allows
RANGE = 4


def _sketched(df: DataFrame, train: str, held: tuple[str, ...]) -> DataFrame:
    """``tbl, id, side, cls, n, odd, bands`` of every text that is long enough."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = nc.Sketch(BANDS, ROWS, SHINGLE)
        for b in batches:
            seen: dict[str, tuple | None] = {}
            rows = []
            for tbl, i, side, text in zip(b["tbl"], b["id"], b["side"], b["text"]):
                if text not in seen:
                    ws = nc.words(text)
                    seen[text] = (nc.fingerprint(ws), len(ws), nc.parities(ws), sketch.keys(ws)) if len(ws) >= LEAST else None
                if seen[text]:
                    rows.append((tbl, i, side, *seen[text]))
            yield pd.DataFrame(rows, columns=["tbl", "id", "side", "cls", "n", "odd", "bands"])

    side = F.when(F.col("split") == train, "t").when(F.col("split").isin(*held), "e")
    texts = df.select("tbl", "id", side.alias("side"), "text").filter(f"side is not null and length(text) >= {2 * LEAST - 1}")
    return spread(texts).mapInPandas(each, "tbl string, id long, side string, cls long, n int, odd array<long>, bands array<long>")


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        p, q = nc.words(x), nc.words(y)
        out.append(nc.jaccard(p, q, SHINGLE) >= SIMILAR and nc.edits(p, q, int(SHARE * max(len(p), len(q)) + 1e-9)) is not None)
    return pd.Series(out, dtype="bool")


def _classes(df: DataFrame, train: str, held: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``tbl, cls, side, id`` of every row, and the links ``tbl, cls_t, cls_e``, as tables."""
    df = df.select("tbl", F.col("id").cast("long").alias("id"), "split", "text")
    rows = cut(_sketched(df, train, held), "sketches")
    members = rows.select("tbl", "cls", "side", "id").distinct()
    classes = rows.groupBy("tbl", "cls", "side").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "odd", "bands")))
    fold = [F.expr(" ^ ".join(f"odd[{j}]" for j in range(i, nc.WIDTH, 2))).alias(f"odd{i}") for i in (0, 1)]
    flat = classes.select("tbl", "side", "cls", "n", *fold, F.explode("bands").alias("key"))
    # lengths on a scale on which the allowed difference is less than 1
    place = F.log("n") / math.log(1 / (1 - SHARE) + 1e-6)
    at = lambda x: F.floor(x / RANGE).cast("int")
    sides = {"t": at(place), "e": F.explode(F.array_distinct(F.array(at(place - 1), at(place + 1))))}
    t, e = (flat.filter(F.col("side") == s).select("tbl", "key", sides[s].alias("range"), *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "odd0", "odd1"))) for s in "te")
    most = F.greatest("n_t", "n_e") * SHARE + 1e-9
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    folded = sum(differ(F.col(f"odd{i}_t"), F.col(f"odd{i}_e")) for i in (0, 1))
    near = (F.abs(F.col("n_t") - F.col("n_e")) <= most) & (folded <= 2 * F.floor(most))
    pairs = t.join(e, ["tbl", "key", "range"]).filter(near).select("tbl", "cls_t", "cls_e").distinct()
    for s in "te":
        side = classes.filter(F.col("side") == s)
        pairs = pairs.join(side.select("tbl", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "rep", "n", "odd"))), ["tbl", f"cls_{s}"])
    whole = sum(differ(F.col("odd_t")[i], F.col("odd_e")[i]) for i in range(nc.WIDTH))
    pairs = cut(pairs.filter(whole <= 2 * F.floor(most)).select("tbl", "cls_t", "cls_e", "rep_t", "rep_e"), "candidates")

    same = pairs.filter("cls_t = cls_e").select("tbl", "cls_t", "cls_e")
    other = pairs.filter("cls_t <> cls_e")
    reps = other.select("tbl", F.col("rep_t").alias("id")).union(other.select("tbl", F.col("rep_e").alias("id"))).distinct()
    texts = df.select("tbl", "id", "text").join(reps, ["tbl", "id"], "left_semi").dropDuplicates(["tbl", "id"])
    both = other
    for s in "te":
        both = both.join(texts.select("tbl", F.col("id").alias(f"rep_{s}"), F.col("text").alias(f"text_{s}")), ["tbl", f"rep_{s}"])
    near = both.filter(_near("text_t", "text_e")).select("tbl", "cls_t", "cls_e").unionByName(same)
    return members, cut(near, "links")


def cross_split_pairs(df: DataFrame, train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """``tbl, id_a, id_b`` for ``df`` with columns ``tbl, id, split, text`` (others are ignored)."""
    members, near = _classes(df, train, held)
    # expansion to rows, in parts of at most about PART rows of a class on either side
    sizes = members.groupBy("tbl", "cls", "side").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    out = near
    for s in "te":
        rows = members.filter(F.col("side") == s).select("tbl", F.col("cls").alias(f"cls_{s}"), F.col("id").alias(s))
        parts = sizes.filter(F.col("side") == s).select("tbl", F.col("cls").alias(f"cls_{s}"), F.col("parts").alias(f"parts_{s}"))
        salted = rows.join(parts, ["tbl", f"cls_{s}"]).withColumn(f"part_{s}", F.pmod(F.xxhash64(s), F.col(f"parts_{s}")).cast("int")).drop(f"parts_{s}")
        out = out.join(parts, ["tbl", f"cls_{s}"]).withColumn(f"part_{s}", F.explode(F.sequence(F.lit(0), F.col(f"parts_{s}") - 1)))
        out = out.drop(f"parts_{s}").join(salted, ["tbl", f"cls_{s}", f"part_{s}"])
    return out.select("tbl", F.least("t", "e").alias("id_a"), F.greatest("t", "e").alias("id_b"))


def links(df: DataFrame, train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """``tbl, id, side, class, n_links`` of every row that is compared: its class (rows with the same
    words) and how many rows of the other side are the same or nearly so. Side ``t`` is training."""
    members, near = _classes(df, train, held)
    sizes = members.groupBy("tbl", "cls", "side").agg(F.count(F.lit(1)).alias("rows"))
    out = None
    for s, o in (("t", "e"), ("e", "t")):
        other = sizes.filter(F.col("side") == o).select("tbl", F.col("cls").alias(f"cls_{o}"), "rows")
        n = near.join(other, ["tbl", f"cls_{o}"]).groupBy("tbl", F.col(f"cls_{s}").alias("cls")).agg(F.sum("rows").alias("n_links"))
        mine = members.filter(F.col("side") == s).join(n, ["tbl", "cls"], "left")
        out = mine if out is None else out.unionByName(mine)
    return out.select("tbl", "id", "side", F.col("cls").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(df: DataFrame, train: str = "train", held: tuple[str, ...] = ("valid", "test")) -> DataFrame:
    """``tbl, split, source, n_rows, n_pairs``: held-out rows found in the training split, and pairs."""
    n = links(df, train, held).filter("side = 'e' and n_links > 0").select("tbl", "id", "n_links")
    rows = df.select("tbl", F.col("id").cast("long").alias("id"), "split", "source").filter(F.col("split").isin(*held)).dropDuplicates(["tbl", "id"])
    return rows.join(n, ["tbl", "id"]).groupBy("tbl", "split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_links").alias("n_pairs"))
