"""Near copies, overlaps across splits and truncation."""

import random
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import nearcopies as nc
from quarry.llm import overlaps
from quarry.llm import truncation as tr


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.integers(0, 8))
def test_edits(a, b, most):
    d = levenshtein(a, b)
    assert nc.edits(a, b, most) == (d if d <= most else None)


def test_sketch_estimates_similarity():
    rnd = random.Random(1)
    a = [f"w{rnd.randrange(1000)}" for _ in range(300)]
    b = a[:]
    for i in rnd.sample(range(300), 15):
        b[i] = "x"
    s = nc.Sketch(64, 1, 3)
    same = sum(x == y for x, y in zip(s.keys(a), s.keys(b))) / 64
    assert abs(same - nc.jaccard(a, b, 3)) < 0.2
    assert s.keys(["one"]) == s.keys(["one"]) and nc.words("É3 x_y") == ["é3", "x", "y"]


def brute(rows):
    out = set()
    split = lambda r: "t" if r[2] == "train" else "e" if r[2] in ("valid", "test") else None
    for p, q in product(rows, rows):
        if split(p) == "t" and split(q) == "e" and p[0] == q[0]:
            a, b = (nc.words(x[3] or "") for x in (p, q))
            n = max(len(a), len(b))
            if min(len(a), len(b)) >= 32 and levenshtein(a, b) <= 0.08 * n:
                out.add((p[0], min(p[1], q[1]), max(p[1], q[1])))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.lists(st.integers(0, 30), max_size=60))
def test_parities_never_exceed_twice_the_distance(a, b):
    a, b = ([f"w{x}" for x in y] for y in (a, b))
    x, y = (np.array(nc.parities(z), np.int64) for z in (a, b))
    assert len(x) == nc.WIDTH and np.bitwise_count((x ^ y).view(np.uint64)).sum() <= 2 * levenshtein(a, b)


def test_template_texts_are_no_candidates(spark, monkeypatch):
    """Texts that fill one template with other words share bands by chance; none is compared in Python."""
    rnd = random.Random(7)
    template = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(200):
        ws = template[:]
        for k in rnd.sample(range(60), 12):
            ws[k] = f"v{rnd.randrange(10**6)}"
        rows.append(("a", i, "train" if i % 2 else "valid", " ".join(ws)))
    kept, cut = {}, overlaps.cut
    monkeypatch.setattr(overlaps, "cut", lambda df, name: kept.setdefault(name, cut(df, name)))
    got = overlaps.cross_split_pairs(spark.createDataFrame(rows, "tbl string, id long, split string, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert kept["candidates"].count() < 20


def test_overlaps_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "PART", 2)
    rnd = random.Random(4)
    base = [[f"v{rnd.randrange(60)}" for _ in range(rnd.randint(30, 70))] for _ in range(5)]
    rows = []
    for i in range(240):
        w = rnd.choice(base)[:]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rnd.randrange(len(w))
            rnd.choice([lambda: w.__setitem__(k, "new"), lambda: w.insert(k, "ins"), lambda: w.pop(k)])()
        rows.append((rnd.choice(["a", "b"]), i, rnd.choice(["train", "valid", "test", "other", None]), " ".join(w) if rnd.random() < 0.5 else ", ".join(w).upper()))
    rows += [("a", 900, "train", None), ("a", 901, "test", ""), ("a", 902, "train", "x " * 20_000), ("a", 903, "test", "x " * 20_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "tbl string, id long, split string, text string, source string, side int")
    pairs = overlaps.cross_split_pairs(df)
    got = [tuple(r) for r in pairs.collect()]
    want = brute([r for r in rows if r[1] < 900]) | {("a", 902, 903)}
    assert len(want) > 100 and len(got) == len(set(got))
    assert set(got) <= want and len(got) >= 0.98 * len(want)
    rep = overlaps.overlap_report(df)
    assert rep.agg({"n_pairs": "sum"}).first()[0] == len(got)
    n = {(r.tbl, r.id): r.n_links for r in overlaps.links(df).collect()}
    assert n == {k: sum(k in ((t, a), (t, b)) for t, a, b in got) for k in n} and sum(n.values()) == 2 * len(got)
    assert overlaps.cross_split_pairs(df.limit(0)).count() == 0


def test_align():
    full = "The lung is clear on image 12.5 today. A nodule of 3 mm lies in the left lobe, see Dr. Bel there."
    known = {"dr": True}
    assert tr.align("The lung is clear on image 12.5 today. A nodule of 3 mm li", full, known) == tr.CUT
    assert tr.align("The lung is clear on image 12.5 today. A nodule of 3 mm lies", full, known) == tr.CUT
    assert tr.align("The lung is clear on image 12", full, known) == tr.CUT
    assert tr.align("The lung is clear on image 12.5 today", full, known) == tr.END
    assert tr.align("The lung is clear on image 12.5 today. A nodule of 3 mm lies in the left lobe, see Dr", full, known) == tr.CUT
    assert tr.align(full[:-1], full, known) == tr.END
    assert tr.align("Something else entirely that has many other words in it", full, known) is None


def test_truncated(spark):
    ends = ["The lung is clear", "The heart is of normal size", "There is no nodule in the left lobe", "A nodule of 3 mm lies in the right lobe"]
    rnd = random.Random(6)
    rows = [(i, ". ".join(rnd.choices(ends, k=rnd.randint(2, 6))) + ".", "s1") for i in range(200)]
    long = "First a unique opening with many words of its own to be found again by the sketch of its head and then some more. " + rows[0][1]
    rows += [
        (1000, "The lung is clear. The heart is of normal size", "s2"),
        (1001, "The lung is clear. The heart is of nor", "s2"),
        (1002, "The lung is clear. There is no nodule in the [...]", "s2"),
        (1003, "The lung is clear. A nodule (3 mm", "s2"),
        (1004, None, "s2"), (1005, " ", "s2"), (1006, "N/A", "s2"), (1007, "The region 0 is lung:", "s2"),
        (1008, "The lung is clear. The region 1 is", "s2"),
        (1009, long, "s3"), (1010, long[:160], "s3"), (1010, long[:160], "s3"),
    ]
    df = spark.createDataFrame(rows, "sample_id long, t string, source string").selectExpr("*", "'x' AS text", "1 AS id")
    got = sorted(r.sample_id for r in tr.truncated(df.drop("id"), "sample_id", ["t"]).collect())
    assert got == [1001, 1002, 1003, 1008, 1010, 1010]
    r = {x.source: (x.n, x.n_truncated) for x in tr.rates(df.drop("id"), "sample_id", ["t"], "source").collect()}
    assert r["s1"] == (200, 0) and r["s2"][1] == 4
    assert tr.truncated(df.drop("id").limit(0), "sample_id", ["t"]).count() == 0


def test_every_text_of_an_opening_is_tried(spark):
    """The longest text of an opening may be another report; a copy may go on by part of a word only."""
    head = " ".join(f"word{i}" for i in range(30))
    rows = [
        (1, f"{head} with a small nodule in the left", "s"),
        (2, f"{head} with a small nodule in the left lower lobe today.", "s"),
        (3, f"{head}. Nothing else is found here. " + "Another report goes on for long. " * 9, "s"),
        (4, f"{head} beside some calcified plaques of the aor", "s"),
        (5, f"{head} beside some calcified plaques of the aorta.", "s"),
    ] + [(10 + i, f"Seen in the left. Number {i} of the aor.", "s") for i in range(9)]
    df = spark.createDataFrame(rows, "sample_id long, t string, source string")
    assert sorted(r.sample_id for r in tr.truncated(df, "sample_id", ["t"]).collect()) == [1, 4]


def test_openings_of_every_length(spark):
    """Texts cut before their 24th word, and copies with edits in their first words, meet their copies."""
    rnd = random.Random(5)
    s = nc.Sketch(tr.BANDS, tr.ROWS, tr.SHINGLE)
    long = [f"w{rnd.randrange(500)}" for _ in range(300)]
    assert s.openings(long, 5).shape == (6, tr.BANDS) and len(s.openings(long[:4], 5)) == 0
    assert [x.tolist() for x in s.openings(long[:25], 5)] == [x.tolist() for x in s.openings(long, 5)[:3]]
    rows, cut = [], []
    for i in range(60):
        full = [f"v{rnd.randrange(2000)}" for _ in range(120)]
        n = rnd.choice([6, 7, 10, 11, 15, 21, 23]) if i < 40 else 110
        part = full[:n]
        if i >= 40:
            for k in rnd.sample(range(24), 3):
                part[k] = "other"
        rows += [(2 * i, " ".join(part)), (2 * i + 1, " ".join(full) + ".")]
        # closing words that end finished sentences say nothing, so only the copy can
        rows += [(1000 + 2 * i + k, f"Text {i} has {k}. So it is {' '.join(part[-4:])}.") for k in range(6)]
        cut.append(2 * i)
    df = spark.createDataFrame(rows, "sample_id long, t string")
    assert sorted(r.sample_id for r in tr.truncated(df, "sample_id", ["t"]).collect()) == cut


def test_no_longest_text_hides_a_copy(spark):
    """The evidence of the copy does not depend on what else shares the opening."""
    full = "The lung is clear on image 12 today and a nodule of 3 mm lies in the left lobe near the hilum."
    rows = [(1, full[:70], "s"), (2, full, "s"), (3, full[:60] + " nothing else. " + "Many other words follow in this one. " * 20, "s")]
    for n in (2, 3):
        df = spark.createDataFrame(rows[:n], "sample_id long, t string, source string")
        got = {r.id: r.by_copy for r in tr.examined(df, "sample_id", ["t"])[1].collect()}
        assert got[1] == 1


def test_filters_keep_what_the_alignment_accepts(spark):
    """Candidates by bit and by succession hold every pair of a shared band that aligns."""
    rnd = random.Random(9)
    texts = []
    for _ in range(25):
        full = [f"v{rnd.randrange(40)}" for _ in range(rnd.randint(8, 90))]
        texts.append(" ".join(full) + ".")
        for _ in range(4):
            part = full[: rnd.randint(6, len(full))]
            for _ in range(rnd.choice([0, 0, 1, 3])):
                k = rnd.randrange(len(part))
                rnd.choice([lambda: part.__setitem__(k, "new"), lambda: part.insert(k, "ins"), lambda: part.pop(k)])()
            texts.append(" ".join(part))
    sketch, judge = nc.Sketch(tr.BANDS, tr.ROWS, tr.SHINGLE), tr.Judge(tr.Verdicts([]))
    known = set(texts)
    rows = [(i, t) for i, t in enumerate(sorted(known))]
    df = spark.createDataFrame(rows, "sample_id long, t string")
    classes = tr._classes(tr._judged(tr._texts(df, "sample_id", ["t"]), tr.Verdicts([])))
    got = {(r.rep_s.id, r.rep_f.id) for r in tr._pairs(classes).collect()}
    want = set()
    words = {i: nc.words(t) for i, t in rows}
    keys = {i: sketch.openings(w, tr.HEAD) for i, w in words.items()}
    rep = {i: min(j for j, u in words.items() if u == w) for i, w in words.items()}
    for i, t in rows:
        w = words[i]
        if judge.verdict(t, judge.split.spans(t))[0] == "whole" or len(w) <= tr.HEAD:
            continue
        level = max(k for k in range(9) if tr.HEAD << k <= len(w) - 1)
        for j, u in rows:
            if i != j and w != words[j] and len(words[j]) >= len(w) and (keys[i][level] == keys[j][level]).any() and tr.align(t, u, {}):
                want.add((rep[i], rep[j]))
    assert len(want) > 40 and want <= got


def test_texts_filed_together_as_alone(monkeypatch):
    rnd = random.Random(3)
    sizes = [*range(45), 79, 80, 81, 320, tr.AT_ONCE - 1, tr.AT_ONCE, tr.AT_ONCE + 1]
    texts = [[f"w{rnd.randrange(40)}" for _ in range(n)] for n in rnd.sample(sizes, len(sizes))]
    sketch = nc.Sketch(tr.BANDS, tr.ROWS, tr.SHINGLE)
    alone, calls = [tr._filed(ws, sketch) for ws in texts], []
    monkeypatch.setattr(tr, "_filed", lambda ws, s, f=tr._filed: calls.append(len(ws)) or f(ws, s))
    for a, b in zip(alone, tr._all_filed(texts, sketch), strict=True):
        assert all(x.shape == y.shape and x.dtype == y.dtype and (x == y).all() for x, y in zip(a, b, strict=True))
    assert sorted(calls) == [*range(tr.HEAD), tr.AT_ONCE + 1]  # all others went together


def test_repeated_sentences_across_splits(spark):
    """A text of one repeated sentence has few distinct shingles, yet few edits leave it near."""
    base = "the lung is quite clear".split() * 10
    rows = [("a", 0, "train", " ".join(base))]
    for i in range(1, 12):
        w = base[:]
        for k in range(4):
            w[(i + 11 * k) % 50] = f"new{i}x{k}"
        rows.append(("a", i, "test", " ".join(w)))
    got = {tuple(r) for r in overlaps.cross_split_pairs(spark.createDataFrame(rows, "tbl string, id long, split string, text string")).collect()}
    assert got == brute(rows) and len(got) == 11
