"""Sentence units on hand-marked texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import sentences as S

CORPUS = (
    ["Measured by Dr. Vel at 3 mm. No change.", "Seen by Dr. Hart on image 4. Stable since then."] * 20
    + ["See fig. 12 and nos. 3, 4 resp. 7 of series 2.", "A nodule, e.g. on image no. 12, approx. 4 mm across."] * 20
    + ["Auf Höhe der 10. Rippe ein Herd, d. h. Serie 3, Bild 5.", "Kein Herd auf Bild 12. Ein Herd links.", "Ein Herd rechts."] * 20
    + ["No change.", "Stable.", "The lung is clear.", "It was clear before. The heart is normal."] * 20
)


@pytest.fixture(scope="module")
def split(spark):
    v = S.verdicts(spark.createDataFrame([(t,) for t in CORPUS], "text string"))
    s = S.Splitter(v)
    return lambda t: [t[a:b] for a, b in s.spans(t)]


CASES = [
    ("No change. Stable.", ["No change.", "Stable."]),
    ("Measured by Dr. Bel at 3.5 mm. No change.", ["Measured by Dr. Bel at 3.5 mm.", "No change."]),
    ("Seen on image 12. Stable.", ["Seen on image 12.", "Stable."]),
    ("Auf Höhe der 9. Rippe ein Herd. Ein Herd links.", ["Auf Höhe der 9. Rippe ein Herd.", "Ein Herd links."]),
    ("The region 0 is lung: Clear. The region 1 is trachea and bronchie: Stable", ["The region 0 is lung:", "Clear.", "The region 1 is trachea and bronchie:", "Stable"]),
    ('He wrote: "A nodule. Please check." No change.', ['He wrote: "A nodule. Please check."', "No change."]),
    ('He said "It hurts. Badly!" before the scan. Stable.', ['He said "It hurts. Badly!" before the scan.', "Stable."]),
    ("1. No change.\n2. Stable.", ["1. No change.", "2. Stable."]),
    ("One line\nstill the same. Next.", ["One line\nstill the same.", "Next."]),
    ("One part\n\nanother part", ["One part", "another part"]),
    ("No change.Stable.", ["No change.", "Stable."]),
    ("A nodule ... image 3 shows it. Stable.", ["A nodule ... image 3 shows it.", "Stable."]),
    ("The lung is cl [...]", ["The lung is cl [...]"]),
    ("Is it larger? No change!", ["Is it larger?", "No change!"]),
    ("结节。直径5.9 mm;密度71HU。是否大于4 mm?未见异常。", ["结节。", "直径5.9 mm;密度71HU。", "是否大于4 mm?", "未见异常。"]),
    ("患者は「咳が出ます。夜に悪化します。」と述べました。異常なし。", ["患者は「咳が出ます。夜に悪化します。」と述べました。", "異常なし。"]),
    ("患者说:“我咳嗽。晚上更重。”未见异常。", ["患者说:“我咳嗽。晚上更重。”", "未见异常。"]),
    ("ไม่พบก้อน พบก้อนขนาด 4 มม. ในภาพที่ 3 ของชุดนี้", ["ไม่พบก้อน", "พบก้อนขนาด 4 มม. ในภาพที่ 3 ของชุดนี้"]),
    ("कोई गांठ नहीं। लगभग 4 मि.मी. की है।", ["कोई गांठ नहीं।", "लगभग 4 मि.मी. की है।"]),
    ("هل هي أكبر؟ لا توجد عقدة.", ["هل هي أكبر؟", "لا توجد عقدة."]),
    ("N/A", ["N/A"]),
    ("...", []),
    ("", []),
    (" \n\t", []),
    ("[]", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_units(split, text, want):
    assert split(text) == want


def test_long_text_and_properties(split):
    t = "The lung is clear. " * 20_000
    got = split(t)
    assert len(got) == 20_000 and set(got) == {"The lung is clear."}


@pytest.mark.parametrize("t", [" " * 200_000 + "x", "." * 200_000, "a. " * 100_000, "„x“ " * 50_000, "\n" * 200_000, "The region " * 50_000, "".join(f"w{i}. v " for i in range(50_000))])
def test_odd_long_texts(split, t):
    got = split(t)
    assert all(u == u.strip() for u in got)


def test_table(spark):
    df = spark.createDataFrame([(1, "No change. Stable.", 5), (2, None, 5), (3, "", 5), (1, "No change. Stable.", 5)], "id long, t string, text int")
    out = S.found({"x": (df, "id", "t")})
    assert sorted(map(tuple, out.collect())) == [("x", 1, 0, 10), ("x", 1, 0, 10), ("x", 1, 11, 18), ("x", 1, 11, 18)]
    assert S.found({"x": (df.limit(0), "id", "t")}).count() == 0


def test_document_evidence(spark):
    """A word the corpus does not know is an abbreviation if its uses in the text say so."""
    s = S.Splitter(S.Verdicts([]))
    t = "The qrx. value is 3, the qrx. value was 4. Another qrx. Value follows"
    assert [t[a:b] for a, b in s.spans(t)] == ["The qrx. value is 3, the qrx. value was 4.", "Another qrx.", "Value follows"]


def cut_by(text, rows):
    s = S.Splitter(S.Verdicts(rows))
    return [text[a:b] for a, b in s.spans(text)]


def test_the_document_comes_before_the_corpus():
    """Rows: word, before a period, going on, at the end, uses, opening."""
    corpus = [("lob", 100, 0, 5, 500, 0), ("seg", 100, 99, 0, 0, 0), ("the", 0, 0, 0, 900, 300), ("is", 0, 0, 0, 900, 0)]
    # by the corpus ``lob`` ends sentences, but this text shortens with it
    shows = "The lob. inferior is clear. Here the lob. superior is not."
    assert cut_by(shows + " It is the lob. Medius.", corpus)[:2] == ["The lob. inferior is clear.", "Here the lob. superior is not."]
    assert cut_by("Here is the lob. Medius is clear.", corpus) == ["Here is the lob.", "Medius is clear."]
    # by the corpus ``seg`` is an abbreviation, but this text has it as a word
    assert cut_by("Here is the seg. Medius is clear.", corpus) == ["Here is the seg. Medius is clear."]
    assert cut_by("This seg is clear. Here is the seg. Medius is clear.", corpus) == ["This seg is clear.", "Here is the seg.", "Medius is clear."]
    # a word that the text has in lower case opens a sentence after an abbreviation, a name does not
    assert cut_by("Here the lung is seen by seg. The lung is clear.", corpus) == ["Here the lung is seen by seg.", "The lung is clear."]
    assert cut_by("Here the lung is seen by seg. Bel as by Bel before.", corpus) == ["Here the lung is seen by seg. Bel as by Bel before."]


def test_words_of_any_length(spark):
    long = "lob" * 30
    dots, words = S.count_words([(f"The {long}. inferior is clear.", 1)])
    assert dots[long] == [1, 1, 0] and words["clear."] == 1
    corpus = [(long, 100, 99, 0, 0, 0)]
    assert cut_by(f"Here is the {long}. Medius is clear.", corpus) == [f"Here is the {long}. Medius is clear."]
    df = spark.createDataFrame([(f"The {long}. inferior is clear. " * 9,)], "text string")
    assert S.verdicts(df).abbreviation[long]


HARD_PARTS = ["the region 0 is lung:", "The  region\n\n3 IS heart muscle :", "\n", "\r\n", "\n\n", " ", "\r\n \r\n", "the region", "region 1 is", "İ", "the\x1cregion 2 is pleura:", "word. ", "\x85\n \n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(HARD_PARTS), max_size=12))
def test_headers_and_blank_lines_as_the_expression_has_them(parts):
    text = "".join(parts)
    assert S.hard(text) == [m.span() for m in S.HARD.finditer(text)]
