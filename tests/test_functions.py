"""Scalar functions against hand-worked cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import arrays, text
from quarry.functions.stem import stem


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())] if cols else [(1,)], schema=None if not cols else [*cols])
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("valid_1199_a_1.nii.gz", "valid_1199a"), ("valid_1199_a", "valid_1199a"), ("valid_1199a", "valid_1199a"), ("PE4529af3", "PE4529af3"), (" train_3_B_2.NII.GZ", "train_3B")])
def test_canonical_id(spark, raw, want):
    assert one(spark, text.canonical_id(F.lit(raw))) == want
    assert one(spark, text.canonical_id(F.lit(want))) == want


def test_sentences(spark):
    s = "The region 0 is lung: No nodule.  Heart is normal. ok"
    assert one(spark, text.sentences(F.lit(s))) == ["The region 0 is lung.", "No nodule.", "Heart is normal. ok"]
    assert one(spark, text.plain_sentences(F.lit(s))) == ["The region 0 is lung: No nodule.", "Heart is normal. ok"]
    assert one(spark, text.sentences(F.lit(None).cast("string"))) == []
    # the index of an element is not taken for characters to trim
    assert one(spark, text.sentences(F.lit("A. B. On image 12"))) == ["A.", "B.", "On image 12"]


def test_negation_and_mentions(spark):
    def both(s):
        low = F.lower(F.lit(s))
        return one(spark, F.struct(text.negated(low).alias("n"), text.mentions(low).alias("m")))

    r = both("No nodule but consolidation is present.")
    assert r.n and r.m == ["Lung nodule", "Consolidation"]
    r = both("This isn't a nodule.")
    assert not r.n and r.m == ["Lung nodule"]


def test_jaccard(spark):
    a, b = (F.split(F.lit(x), " ") for x in ("a b c d e f", "a b c d e g"))
    assert one(spark, text.ngram_jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, text.ngram_jaccard(F.split(F.lit("a b"), " "), b)) == 0.0
    assert one(spark, text.set_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_prefix_finish_shorten(spark):
    assert one(spark, text.dedup_prefix(F.lit("Nodule, 3 mm (right)!"))) == "nodule 3 mm right"
    assert one(spark, text.finished(F.lit("A nodule. . ."))) == "A nodule."
    assert one(spark, text.shortened(F.lit("a b c d"), 3)) == "a b c."
    assert one(spark, text.shortened(F.lit("a b c"), 3)) == "a b c"


def test_measure_and_places(spark):
    low = F.lit("a 3 mm nodule in the right upper lobe.")
    assert one(spark, text.measured(low)) and one(spark, text.places(low)) == 3
    assert one(spark, text.measured(F.lit("14x10 lesion"))) and not one(spark, text.measured(F.lit("image 14")))


@pytest.mark.parametrize("v", [0.591, 1.0, 0.0, 0.5095, 0.0625, 0.0005, 0.0015, 0.4995, 0.99951, 0.00049999])
def test_metric_cell_rounds_as_python(spark, v):
    assert one(spark, text.metric_cell(F.lit(v), F.lit(False))) == f"{v:.3f}".removeprefix("0")
    assert one(spark, text.metric_cell(F.lit(v), F.lit(True))) == "\\textbf{" + f"{v:.3f}".removeprefix("0") + "}"


def test_paths_and_clock(spark):
    assert one(spark, text.accession(F.lit("ct/train/train_1.x/train_1_a_1.nii.gz"))) == "train_1"
    assert one(spark, text.stem_of(F.lit("ct/train_1_a_1.nii.gz"))) == "train_1_a_1"
    assert one(spark, text.cache_key(F.lit("a/b/c.csv"))) == "a__b__c.csv"
    assert one(spark, text.clock(F.lit(3661.9))) == "01:01:01"


def test_arrays(spark):
    assert one(spark, arrays.temperatures(F.lit(3), 0.7, 1.3)) == pytest.approx([0.7, 1.0, 1.3])
    assert one(spark, arrays.temperatures(F.lit(1), 0.7, 1.3)) == pytest.approx([0.7])
    assert arrays.intensity_passes(3) == [pytest.approx((0.9, -0.05)), pytest.approx((0.95, -0.025)), pytest.approx((1.0, 0.0))]
    assert one(spark, arrays.windowed(F.array(F.lit(-2000.0), F.lit(200.0), F.lit(900.0)))) == [-1.0, 1.0, 1.0]
    ids = F.array(*(F.lit(x) for x in (5, 6, 7, 99, 0)))
    assert one(spark, arrays.training_labels(ids, F.lit(2), 50)) == [-100, -100, 7, -100, -100]
    assert one(spark, arrays.padded(F.array(F.lit(1)), F.lit(3))) == [1, 0, 0]
    assert one(spark, arrays.exact_match(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(-100))))
    assert one(spark, arrays.ratio(F.lit(1), F.lit(0))) == 0.0
    v = F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)), F.array(F.lit(9.0), F.lit(9.0)))
    assert one(spark, arrays.mean_pool(v, F.array(F.lit(1), F.lit(1), F.lit(0)))) == [2.0, 4.0]
    assert one(spark, arrays.mean_pool(v, F.array(F.lit(0), F.lit(0), F.lit(0)))) == [0.0, 0.0]


def test_stems():
    cases = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "rate": "rate", "cease": "ceas"}
    assert {w: stem(w) for w in cases} == cases


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abc", max_size=3), max_size=8), st.lists(st.text("abc", max_size=3), max_size=8))
def test_lcs_against_table(a, b):
    from quarry.operators.nlg import lcs

    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert lcs(a, b) == t[-1][-1]
