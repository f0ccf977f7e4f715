"""Scalar functions on numbers and arrays as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(0.0)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def temperatures(k: Column, low: float, high: float) -> Column:
    """Evenly spaced from ``low`` to ``high``; one candidate gets ``low``."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.lit(low) + F.lit(high - low) * i / F.greatest(k - 1, F.lit(1)))


def intensity_passes(n: int) -> list[tuple[float, float]]:
    """Scale and shift of each test-time pass."""
    return [(0.9 + 0.05 * i, -0.05 + 0.025 * i) for i in range(n)]


def windowed(values: Column, low: float = -1000.0, high: float = 200.0, shift: float = 400.0, scale: float = 600.0) -> Column:
    """Clamped and normalised intensities."""
    return F.transform(values, lambda x: (F.least(F.greatest(x, F.lit(low)), F.lit(high)) + shift) / scale)


def masked(values: Column, mask: Column, outside: float = -1024.0) -> Column:
    return F.zip_with(values, mask, lambda x, m: F.when(m != 0, x).otherwise(F.lit(outside)))


def has_any(mask: Column) -> Column:
    """Is any element of the mask set?"""
    return F.aggregate(mask, F.lit(0.0), lambda a, x: a + x) != 0


def training_labels(ids: Column, prompt: Column, vocabulary: int, pad: int = 0, ignore: int = -100) -> Column:
    """Token labels: padding, ids beyond the vocabulary and the prompt are ignored."""
    return F.transform(ids, lambda x, i: F.when((x == pad) | (x >= vocabulary) | (i < prompt), F.lit(ignore)).otherwise(x))


def ended(ids: Column, valid: Column, end: int) -> Column:
    """The token after the ``valid`` ones becomes the end of the text; a full row stays as it is."""
    return F.transform(ids, lambda x, i: F.when(i == valid, F.lit(end)).otherwise(x))


def by_hash(items: Column, name: Callable[[Column, Column], Column]) -> Column:
    """Strings in the order of the MD5 hash of their ``name(item, position)``."""
    keyed = F.transform(items, lambda x, i: F.struct(F.md5(name(x, i).cast("binary")).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def padded(ids: Column, length: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0))))


def positive(logit: Column) -> Column:
    """``sigmoid(logit) > 0.5``."""
    return (logit > 0).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def exact_match(predicted: Column, label: Column, ignore: int = -100) -> Column:
    """Do the sequences agree wherever the label is not ignored?"""
    return F.forall(F.zip_with(predicted, label, lambda p, t: (t == ignore) | p.eqNullSafe(t)), lambda x: x)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is set; zeros if none is."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"] != 0)
    total = F.aggregate(kept, F.transform(vectors[0], lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
