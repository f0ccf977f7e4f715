"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import lexicon
from quarry.functions.arrays import by_hash


def canonical_id(c: Column) -> Column:
    """Volume id without the image suffix; ``x_a_1``, ``x_a`` and ``xa`` are one id."""
    bare = F.regexp_replace(F.trim(c), r"(?i)\.nii\.gz$", "")
    return F.regexp_replace(bare, r"(?i)_([a-z])(?:_\d+)?$", "$1")


def squeeze(c: Column) -> Column:
    """White space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _split(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.trim(s)), lambda s: s != "")


def sentences(c: Column) -> Column:
    """Sentences of a report; the colon of a region header ends a sentence. Null gives ``[]``."""
    return _split(F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), r":\s+(?=[A-Z])", ". "))


def shuffled_sentences(c: Column, key: Column, seed: int) -> Column:
    """The text with its sentences in an order fixed by seed and key: an augmentation of training texts."""
    return F.array_join(by_hash(sentences(c), lambda x, i: F.concat_ws("-", F.lit(str(seed)), key.cast("string"), i.cast("string"))), " ")


def plain_sentences(c: Column) -> Column:
    """Sentences without the header rule, as the phrase audit counts them."""
    return _split(squeeze(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Lower-case words between white space; empty text gives ``[]``."""
    return F.filter(F.split(squeeze(F.lower(F.coalesce(c, F.lit("")))), " "), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words as strings, in order; fewer words give ``[]``."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def ngram_jaccard(a: Column, b: Column, n: int = 5) -> Column:
    """Jaccard similarity of the word ``n``-grams; 0 if a side has fewer words."""
    return F.when((F.size(a) >= n) & (F.size(b) >= n), set_jaccard(ngrams(a, n), ngrams(b, n))).otherwise(0.0)


def negated(lower: Column, cues: Sequence[str] = lexicon.NEGATIONS) -> Column:
    """Does a negation cue stand anywhere in the sentence?"""
    return lower.rlike("|".join(cues))


def mentions(lower: Column, synonyms: Mapping[str, Sequence[str]] = lexicon.SYNONYMS) -> Column:
    """The conditions named in a sentence, in label order: one alternation for each condition, no join."""
    return F.array_compact(F.array(*(F.when(lower.rlike("|".join(ps)), F.lit(c)) for c, ps in synonyms.items())))


def measured(lower: Column) -> Column:
    return lower.rlike(lexicon.MEASUREMENT)


def places(lower: Column) -> Column:
    return F.regexp_count(lower, F.lit(lexicon.LOCATION))


def dedup_prefix(c: Column, n: int = 40) -> Column:
    return F.left(F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " ")), F.lit(n))


def finished(c: Column) -> Column:
    """One full stop at the end, whatever dots and blanks stood there."""
    return F.concat(F.regexp_replace(c, r"(?<![. ])[. ]++$", ""), F.lit("."))


def shortened(c: Column, words: int = 80) -> Column:
    """At most ``words`` words; a cut text ends with a full stop."""
    ws = F.filter(F.split(squeeze(c), " "), lambda w: w != "")
    return F.when(F.size(ws) > words, F.concat(F.array_join(F.slice(ws, 1, words), " "), F.lit("."))).otherwise(c)


def accession(path: Column) -> Column:
    """Name of the folder that holds a file, without anything after its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -2), ".", 1)


def stem_of(path: Column) -> Column:
    """Name of a file without anything after its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def folder_key(path: Column) -> Column:
    """Short key of a folder's cached listing."""
    return F.left(F.md5(path.cast("binary")), F.lit(8))


def cache_key(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("__"))


def clock(seconds: Column) -> Column:
    """Elapsed seconds as ``HH:MM:SS``."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def thousandths(v: Column) -> Column:
    return in_parts(v, 1000)


def in_parts(v: Column, n: int) -> Column:
    """A number from 0 to 1 in ``n``-ths, rounded by its exact binary value with ties to even.

    Neither ``round`` nor ``format_string`` does this: both round the shortest decimal form, so
    0.5095 (just below that decimal) would become 510 thousandths. Scaled by a power of two the double is a whole
    number, which decimals compare with the middle between two parts without any error."""
    small = v < 2.0**-9
    k = F.floor(v * n).cast("long")
    scale = F.when(small, 2.0**71).otherwise(2.0**62)
    whole = F.when(v < 1, v * scale).otherwise(0.0).cast("long").cast("decimal(20,0)") * F.lit(2 * n).cast("decimal(10,0)")
    unit = F.when(small, F.lit(str(2**71)).cast("decimal(24,0)")).otherwise(F.lit(str(2**62)).cast("decimal(24,0)"))

    def up(k: Column) -> Column:
        middle = (2 * k + 1).cast("decimal(10,0)") * unit
        return F.when((whole > middle) | ((whole == middle) & (k % 2 == 1)), k + 1).otherwise(k)

    # the product above may have been rounded up to the next part
    k = F.when(whole < (2 * k).cast("decimal(10,0)") * unit, k - 1).otherwise(k)
    return F.when(v >= 1, F.round(v * n).cast("long")).otherwise(up(k))


def metric_cell(v: Column, bold: Column) -> Column:
    """Three decimals without a leading zero, bold on demand."""
    k = thousandths(v)
    whole = F.when(k >= 1000, F.floor(k / 1000).cast("string")).otherwise("")
    cell = F.concat(whole, F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))
    return F.when(bold, F.concat(F.lit("\\textbf{"), cell, F.lit("}"))).otherwise(cell)


def region_sentence(i: Column, region: Column, body: Column) -> Column:
    return F.concat(F.lit("The region "), i.cast("string"), F.lit(" is "), region, F.lit(": "), body)


def placeholder_prompt(question: Column, regions: Column, image_tokens: int = 32, region_tokens: int = 33) -> Column:
    """A prompt with the placeholders of the image and of each region before the question."""
    image = F.concat(F.lit("<image>"), F.lit("".join(f"<image{i}>" for i in range(image_tokens))), F.lit("</image>"))
    one = "".join(f"<region{i}>" for i in range(region_tokens))
    each = F.array_join(F.transform(regions, lambda r, i: F.concat(F.lit("The region "), i.cast("string"), F.lit(" is <region>"), F.lit(one), F.lit("</region>. "))), "")
    return F.concat(image, each, F.coalesce(question, F.lit("")))
