"""BLEU, ROUGE-L and METEOR of generated against reference texts.

Each row is reduced to sufficient statistics in one Arrow batch pass (counting n-grams and aligning
words have no JVM-side form that is linear in the text). Corpus scores are then plain aggregates, so
a resample of rows needs no second look at the texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quarry.functions.stem import stem
from quarry.functions.text import squeeze
from quarry.plans.spread import spread

STATS = ["clip1", "clip2", "clip3", "clip4", "tot1", "tot2", "tot3", "tot4", "hyp_len", "ref_len"]
_TYPE = StructType([StructField(c, LongType()) for c in STATS] + [StructField("rouge_l", DoubleType()), StructField("meteor", DoubleType())])
_ALNUM = re.compile(r"[^a-z0-9]+")


def bleu_stats(ref: list[str], hyp: list[str]) -> list[int]:
    clips, totals = [], []
    for n in range(1, 5):
        r, h = (Counter(zip(*(ws[i:] for i in range(n)))) for ws in (ref, hyp))
        clips.append((r & h).total())
        totals.append(max(1, len(hyp) - n + 1))
    return [*clips, *totals, len(hyp), len(ref)]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer step for each word of ``b``."""
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = where.get(w, 0) & row
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def rouge_tokens(text: str) -> list[str]:
    return [stem(w) if len(w) > 3 else w for w in _ALNUM.sub(" ", text.lower()).split()]


def rouge_l(ref: str, hyp: str) -> float:
    a, b = rouge_tokens(ref), rouge_tokens(hyp)
    if not a or not b:
        return 0.0
    n = lcs(a, b)
    p, r = n / len(b), n / len(a)
    return 2 * p * r / (p + r) if n else 0.0


def meteor(ref: list[str], hyp: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, synonyms: dict[str, str] | None = None) -> float:
    """Exact matches first, then equal stems, then a table of synonyms if one is given."""
    pairs: list[tuple[int, int]] = []
    left_h, left_r = list(enumerate(hyp)), list(enumerate(ref))
    stages = [lambda w: w, stem] + ([lambda w: synonyms.get(w, w)] if synonyms else [])
    for form in stages:
        spots: dict[str, list[int]] = defaultdict(list)
        for j, w in left_r:
            spots[form(w)].append(j)
        rest, used = [], set()
        for i, w in reversed(left_h):
            at = spots.get(form(w))
            if at:
                j = at.pop()
                pairs.append((i, j))
                used.add(j)
            else:
                rest.append((i, w))
        left_h = rest[::-1]
        left_r = [x for x in left_r if x[0] not in used]
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    p, r = len(pairs) / len(hyp), len(pairs) / len(ref)
    mean = p * r / (alpha * p + (1 - alpha) * r)
    return (1 - gamma * (chunks / len(pairs)) ** beta) * mean


def _stats(synonyms: dict[str, str] | None):
    @F.pandas_udf(_TYPE)
    def stats(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(ref, hyp):
            a, b = r.lower().split(), h.lower().split()
            rows.append((*bleu_stats(a, b), rouge_l(r, h), meteor(a, b, synonyms=synonyms)))
        return pd.DataFrame(rows, columns=[f.name for f in _TYPE])

    return stats


#: most words of a table of synonyms, which every task holds
SYNONYMS = 1_000_000


def synonym_groups(table: DataFrame) -> dict[str, str]:
    """A table ``word, concept`` as a mapping; the least concept of each word counts."""
    groups = table.groupBy("word").agg(F.min("concept").alias("concept"))
    if (n := groups.count()) > SYNONYMS:
        raise ValueError(f"{n} words with synonyms, more than {SYNONYMS}")
    return {r.word: r.concept for r in groups.collect()}


def row_stats(df: DataFrame, ref: str, hyp: str, synonyms: DataFrame | None = None) -> DataFrame:
    """The rows whose two texts are not blank, with their statistics. ``synonyms``: ``word, concept``;
    words of one concept match in the last stage of METEOR."""
    stats = _stats(synonym_groups(synonyms) if synonyms is not None else None)
    full = df.filter((squeeze(F.col(ref)) != "") & (squeeze(F.col(hyp)) != ""))
    return spread(full).withColumn("__s", stats(ref, hyp)).select(*df.columns, "__s.*")


def bleu(n: int, prefix: str = "") -> Column:
    """Corpus BLEU with uniform weights from summed statistics; an n-gram order without a match
    counts as 0.1 match."""
    s = lambda c: F.col(prefix + c).cast("double")
    logs = sum((F.log(F.when(s(f"clip{i}") > 0, s(f"clip{i}")).otherwise(0.1) / s(f"tot{i}")) / n for i in range(1, n + 1)), F.lit(0.0))
    brevity = F.when(s("hyp_len") > s("ref_len"), 1.0).when(s("hyp_len") == 0, 0.0).otherwise(F.exp(1 - s("ref_len") / s("hyp_len")))
    return F.when(F.coalesce(s("clip1"), F.lit(0.0)) == 0, 0.0).otherwise(brevity * F.exp(logs))


def corpus_scores(stats: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, bleu1..4, meteor, rouge_l`` in percent, two decimals."""
    agg = stats.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in STATS), F.avg("meteor").alias("m"), F.avg("rouge_l").alias("r"))
    return agg.select(*by, "n", *(F.bround(bleu(i) * 100, 2).alias(f"bleu{i}") for i in range(1, 5)), F.bround(F.col("m") * 100, 2).alias("meteor"), F.bround(F.col("r") * 100, 2).alias("rouge_l"))
