"""Operators against hand-worked cases, plain Python models and properties."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import lexicon
from quarry.config import DEFAULT
from quarry.operators import align, audit, bootstrap, candidates, classification, diff, fusion, nlg, regions, sampling, tensors, texthead
from quarry.plans.number import numbered


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 3, "z"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    assert {(r.k, r.v) for r in align.keep_first(df, ["k"], "o").collect()} == {("a", None), ("b", "z"), (None, "m")}
    assert {(r.k, r.v) for r in align.keep_last(df, ["k"], "o").collect()} == {("a", "x"), ("b", "z"), (None, "n")}


def test_alignment(spark):
    a = spark.createDataFrame([("v1", 2, 1.0), ("v2", 1, 2.0)], "id string, ord int, s double")
    b = spark.createDataFrame([("v2", 9, 5.0), ("v1", 8, 6.0), ("v3", 7, 7.0)], "id string, ord int, s double")
    got = {r.row: (r.id, r.s_base, r.s_ours) for r in align.paired(a, b, "id", "ord").collect()}
    assert got == {0: ("v2", 2.0, 5.0), 1: ("v1", 1.0, 6.0)}
    assert rows(align.pending(b.select("id"), a, "id")) == [("v3",)]
    assert rows(align.reported(b.select("id"), a, "id")) == [("v1",), ("v2",)]
    assert rows(align.gather(b.select("id"), a.select("id", "s"), "id"))[2] == ("v3", None)


def test_best_key_rewrite_prefers_the_first_of_equals(spark):
    have, want = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (["m.a", "m.b"], ["a", "b"]))
    strategies = {"as_is": lambda c: c, "stripped": lambda c: F.regexp_replace(c, "^m[.]", ""), "again": lambda c: F.substring(c, 3, 9)}
    assert rows(align.best_key_rewrite(have, want, strategies)) == [("stripped", 2)]


def test_numbered(spark):
    xs = list(range(1000))
    random.Random(1).shuffle(xs)
    got = numbered(spark.createDataFrame([(x,) for x in xs], "x int"), "x").collect()
    assert len(got) == 1000 and all(r.row == r.x for r in got)
    assert numbered(spark.createDataFrame([], "x int"), "x").count() == 0


@pytest.mark.parametrize("m, least", [(3, 2), (4, 3), (6, 4)])
def test_majority_threshold(spark, m, least):
    names = [f"s{i}" for i in range(m)]
    cat = fusion.catalogue(spark, {"f": names})
    v = [(s, "k", [int(i < n) for n in range(m + 1)]) for i, s in enumerate(names)]
    got = {r.mode: r.labels for r in fusion.fuse(spark.createDataFrame(v, "source string, key string, labels array<int>"), cat, m + 1).collect()}
    assert got["or"] == [0] + [1] * m
    assert got["majority"] == [int(n >= least) for n in range(m + 1)]
    assert "and" not in got


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), min_size=4, max_size=4), min_size=2, max_size=4), st.randoms())
def test_fusion_order_and_invariance(spark, labels, rnd):
    names = [f"s{i}" for i in range(len(labels))]
    shuffled = labels[:]
    rnd.shuffle(shuffled)

    def fused(ls):
        v = spark.createDataFrame([(s, "k", x) for s, x in zip(names, ls)], "source string, key string, labels array<int>")
        return {r.mode: r.labels for r in fusion.fuse(v, fusion.catalogue(spark, {"f": names}), 4).collect()}

    a = fused(labels)
    assert a == fused(shuffled)
    low = a.get("and") or a["majority"]
    assert all(x >= y for x, y in zip(a["or"], low))


def test_fusion_drops_incomplete_keys(spark):
    v = spark.createDataFrame([("a", "k1", [1]), ("b", "k1", [0]), ("a", "k2", [1])], "source string, key string, labels array<int>")
    cat = fusion.catalogue(spark, {"p": ["a", "b"], "q": ["c", "d"]})
    f = fusion.fuse(v, cat, 1)
    assert rows(f) == [("p", "and", "k1", [0]), ("p", "or", "k1", [1])]
    t = spark.createDataFrame([("gt", "k1", [1])], "source string, key string, labels array<int>")
    s = classification.micro_macro(fusion.pairs_with_truth(f, t), ["fusion", "mode"])
    assert rows(fusion.summary(s, cat)) == [("p", "and", "0.0000"), ("p", "or", "1.0000"), ("q", "and", "FAILED"), ("q", "or", "FAILED")]
    assert [fusion.modes(n) for n in (2, 3)] == [["or", "and"], ["or", "majority"]]


def test_scores(spark):
    pairs = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)]
    df = spark.createDataFrame([("x", g, p) for g, p in pairs], "k string, gt int, pred int")
    r = classification.scored(classification.confusion(df, ["k"])).first()
    assert (r.precision, r.recall, round(r.f1, 6), r.support) == (0.75, 0.6, 0.666667, 5)
    z = classification.scored(classification.confusion(spark.createDataFrame([("x", 0, 0)], "k string, gt int, pred int"), ["k"])).first()
    assert (z.precision, z.recall, z.f1) == (0.0, 0.0, 0.0)


def test_candidates(spark):
    df = spark.createDataFrame([("s", 0, "a b c"), ("s", 1, "a b d"), ("s", 2, "x y"), ("t", 0, "one"), ("u", 0, None)], "id string, k int, text string")
    assert dict(rows(candidates.united(df, "id", "k", "text"))) == {"s": "a b c a b d x y", "t": "one", "u": ""}
    assert dict(rows(candidates.self_consistent(df, "id", "k", "text", 1))) == {"s": "a b c", "t": "one", "u": ""}
    assert dict(rows(candidates.self_consistent(df, "id", "k", "text", 2)))["s"] == "a b c a b d"
    assert dict(rows(candidates.self_consistent(df, "id", "k", "text", 5)))["s"] == "a b c a b d x y"
    scored = df.withColumn("z", F.when(F.col("k") == 2, None).otherwise(1.0))
    assert dict(rows(candidates.best_scored(scored, "id", "k", "z", "text"))) == {"s": "a b c", "t": "one", "u": None}


def test_audit_counts_an_equal_sentence_twice(spark):
    df = spark.createDataFrame([(1, "Heart is fine. Heart is fine."), (2, "Heart is very fine."), (3, None), (4, " ")], "o int, t string")
    c = audit.sentence_counts(df, "t", "o")
    assert rows(audit.most_frequent(c, 1)) == [("heart is fine.", 2)]
    r = audit.phrase_audit(c, {"heart": "Heart is fine."}, accept=5).first()
    assert (r.exact, r.fuzzy, r.status) == (2, 3, "VALIDATED")


def test_regions(spark):
    df = spark.createDataFrame([("v_a_1", "Lung ", "old", 1), ("v_a_1", "lung", "new", 2), ("va", None, "all", 3), ("va", "heart", None, 4)], "Volumename string, Anatomy string, Sentence string, row_id long")
    last = regions.latest(df)
    assert set(map(tuple, last.collect())) == {("va", "lung", "new"), ("va", "whole", "all"), ("va", "heart", None)}
    every = {r.region: r.text for r in regions.with_every_region(last).collect()}
    assert every["lung"] == "new" and every["heart"] == "" and len(every) == 9
    assert regions.combined(last).first().report == "The region 0 is lung: new "


def test_differences(spark):
    schema = "id long, v string, t string"
    a = [(1, "x_a_1", "same  text"), (2, None, "A"), (3, "y", "café"), (4, "z", "only"), (5, "w", "one"), (5, "w", "one"), (None, "n", "n")]
    b = [(1, "xa", " same text"), (2, "", "a"), (3, "y", "café"), (5, "w", "one"), (6, "q", "new"), (6, "q", "new"), (None, "n", "m")]
    d = diff.differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", ["v", "t"], id_fields=["v"])
    assert sorted(map(tuple, d.collect()), key=str) == sorted([(2, "t"), (4, "only_in_left"), (6, "only_in_right"), (None, "t")], key=str)
    none = spark.createDataFrame([], schema)
    assert rows(diff.differences(none, none, "id", ["v", "t"])) == []
    assert {r.diff for r in diff.differences(spark.createDataFrame(a[:1], schema), none, "id", ["v", "t"]).collect()} == {"only_in_left"}
    clash = spark.createDataFrame([(1, "x", "t", 1, "s")], "id long, v string, t string, sign int, field string")
    assert rows(diff.differences(clash, clash, "id", ["v", "t"])) == []


def _split(t):
    t = re.sub(r"\s+", " ", t).strip()
    t = re.sub(r":\s+(?=[A-Z])", ". ", t)
    return [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t) if p.strip()]


def model_report(texts, fused):
    """The report of one volume in plain Python, written from the description of the operator."""
    neg = re.compile("|".join(lexicon.NEGATIONS))
    cands = []
    for p, t in enumerate(texts):
        for s in _split(t):
            low = s.lower()
            hit = [c for c, ps in lexicon.SYNONYMS.items() if any(re.search(x, low) for x in ps)]
            isn = bool(neg.search(low))
            cands.append({"p": p, "s": s, "w": low.split(), "pos": [] if isn else hit, "neg": hit if isn else []})

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for c in cands:
        near = set()
        for o in cands:
            if o["p"] != c["p"] and len(c["w"]) > 4 and len(o["w"]) > 4:
                g, h = grams(c["w"]), grams(o["w"])
                if len(g & h) / len(g | h) >= 0.4:
                    near.add(o["p"])
        low = c["s"].lower()
        score = 5.0 if re.search(lexicon.MEASUREMENT, low) else 0.0
        score += 2.0 * min(len(re.findall(lexicon.LOCATION, low)), 3)
        score += 0.1 * min(len(c["w"]), 50)
        score += 3.0 * len(near)
        c["score"] = score - 4.0 * sum(fused[lexicon.LABELS.index(x)] == 0 for x in c["pos"])
    lines, seen = {r: [] for r in lexicon.REGIONS}, set()
    for i, name in enumerate(lexicon.LABELS):
        fit = sorted((c for c in cands if name in (c["pos"] if fused[i] else c["neg"])), key=lambda c: -c["score"])
        n = 0
        for c in fit:
            prefix = re.sub(r"\W+", " ", c["s"].lower()).strip()[:40]
            if n < 3 and prefix not in seen:
                seen.add(prefix)
                s = c["s"] if len(c["s"].split()) <= 80 else " ".join(c["s"].split()[:80]) + "."
                lines[lexicon.REGION[name]].append(s.rstrip(". ") + ".")
                n += 1
        if not n:
            lines[lexicon.REGION[name]].append(f"{name} was detected." if fused[i] else f"{name} was not detected.")
    for r, ls in lexicon.STOCK.items():
        lines[r] += ls
    return " ".join(f"The region {i} is {r}: {' '.join(lines[r])}" for i, r in enumerate(x for x in lexicon.REGIONS if lines[x]))


def test_text_head_against_model(spark):
    rnd = random.Random(5)
    parts = ["A 3 mm nodule in the right upper lobe.", "No pleural effusion is seen.", "Bilateral pleural effusion measuring 14x10 mm in the left hemithorax.", "There is a calcified plaque in the aortic arch and a nodule in the left lower lobe.", "Emphysema in both upper lobes.", "No evidence of emphysema or nodule in the right lung.", "Heart size is normal.", "Patchy consolidation in the posterior segment of the left lower lobe, ground-glass around it.", "Consolidation in the posterior segment of the left lower lobe with ground-glass around it."]
    texts, fused = {}, {}
    for v in range(12):
        texts[f"v{v}"] = ["The region 0 is lung: " + " ".join(rnd.choices(parts, k=rnd.randint(0, 6))) for _ in range(3)]
        fused[f"v{v}"] = [rnd.randint(0, 1) for _ in lexicon.LABELS]
    texts["empty"], fused["empty"] = ["", "", ""], [0] * 18
    t = spark.createDataFrame([(v, p, x) for v, xs in texts.items() for p, x in enumerate(xs)], "volume string, p_idx int, text string")
    f = spark.createDataFrame(list(fused.items()), "volume string, labels array<int>")
    got = dict(map(tuple, texthead.build(t, f).collect()))
    assert got == {v: model_report(texts[v], fused[v]) for v in texts}
    assert all(re.findall(r"The region (\d) is", r) == list("012345678") for r in got.values())


def test_score_of_one_sentence(spark):
    t = spark.createDataFrame([("v", 0, "A 3 mm nodule in the right upper lobe.")], "volume string, p_idx int, text string")
    f = spark.createDataFrame([("v", [1] * 18)], "volume string, labels array<int>")
    c = texthead.candidates(t)
    r = texthead.scored(c, texthead.agreement(c), f, cfg=DEFAULT).first()
    assert r.score == pytest.approx(11.9) and r.agreement == 0 and r.n_poll == 0


def test_nlg(spark):
    ref, hyp = "the cat sat on the mat", "the cat sat on mat"
    df = spark.createDataFrame([("s", ref, hyp), ("s", " ", "x"), ("s", None, "x")], "source string, r string, h string")
    s = nlg.row_stats(df, "r", "h")
    assert s.count() == 1
    r = s.select(*(nlg.bleu(i).alias(f"b{i}") for i in range(1, 5)), "rouge_l").first()
    assert [round(x, 6) for x in r] == [0.818731, 0.709042, 0.649827, 0.578930, 0.909091]
    same = "one two three four five".split()
    assert nlg.meteor(same, same) == pytest.approx(1 - 0.5 / 125)
    assert nlg.meteor(["a"], ["b"]) == 0.0 and nlg.rouge_l("", "x") == 0.0
    assert nlg.meteor(["cars"], ["car"]) > 0 and nlg.meteor(["car"], ["auto"], synonyms={"auto": "car"}) > 0


def test_bootstrap(spark):
    d = spark.createDataFrame([(float(i),) for i in range(100)], "delta double")
    r = bootstrap.interval(d).first()
    assert (round(r.ci_lower, 3), round(r.ci_upper, 3), r.n_ok, r.p_greater) == (2.475, 96.525, 100, 0.99)
    w = bootstrap.weights(spark, 5, 40)
    assert {x.s for x in w.groupBy("b").agg(F.sum("w").alias("s")).collect()} == {40}
    scores = spark.range(40).select(F.col("id").alias("row"), F.lit(1.0).alias("base"), F.lit(3.0).alias("ours"))
    assert {x.delta for x in bootstrap.mean_deltas(scores, w, "base", "ours").collect()} == {2.0}


def test_sampling(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    assert sorted(r.id for r in sampling.buffered_shuffle(df, 50, 3).collect()) == list(range(500))
    t = sampling.top_random(df, "g", 7, 1, "id")
    assert {r["count"] for r in t.groupBy("g").count().collect()} == {7}
    assert rows(t) == rows(sampling.top_random(df.repartition(7), "g", 7, 1, "id"))
    a, b = (rows(sampling.epoch_order(df.select("id"), "id", 1, e)) for e in (0, 1))
    assert a != b and sorted(p for _, p in a) == list(range(500))
    assert {r["count"] for r in sampling.assigned(df, "id", 4).groupBy("worker").count().collect()} == {125}


def test_too_many_candidates_are_an_error(spark):
    df = spark.createDataFrame([("s", i, "a b") for i in range(5)], "id string, k int, text string")
    assert candidates.united(df, "id", "k", "text").count() == 1
    with pytest.raises(ValueError, match="5 candidates"):
        candidates.checked(df, "id", 4)


def test_contrastive_loss_of_large_scores(spark):
    rows = [(i, j, 2000.0 if i == j else 1990.0) for i in range(3) for j in range(3)]
    got = candidates.contrastive_loss(spark.createDataFrame(rows, "i int, j int, sim double"), "i", "j", "sim").first().loss
    assert abs(got - math.log(1 + 2 * math.exp(-10))) < 1e-9


def test_running_count_of_a_hot_group(spark):
    rows = [(None if i % 7 == 0 else i % 2, i, i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, f boolean")
    got = {r.o: r.seen for r in tensors.running_count(df, "g", "o", "f").collect()}
    assert got == {o: sum(f2 for g2, o2, f2 in rows if g2 == g and o2 <= o) for g, o, _ in rows}


def test_poisson_bootstrap(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 10) + 1 + (i % 3)) for i in range(300)], "k int, base double, ours double")
    deltas = bootstrap.poisson_deltas(rows, 200, "k", "base", "ours")
    i = bootstrap.interval(deltas).first()
    assert i.n_ok == 200 and abs(i.mean_delta - 2) < 0.05 and 1.8 < i.ci_lower < 2 < i.ci_upper < 2.2
    w = spark.range(20_000).select(bootstrap.poisson(1, F.lit(0), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert abs(w.m - 1) < 0.03 and abs(w.v - 1) < 0.06


def test_text_report(spark):
    s = spark.createDataFrame([("a", 0.625, 0.125, 0.295, 7), ("b", 1.0, 0.0, 0.375, 0)], "name string, precision double, recall double, f1 double, support int")
    want = ["%-34s %9.2f %9.2f %9.2f %9d" % tuple(r) for r in s.collect()]
    assert [r.line for r in classification.text_report(s, "name").collect()] == want


def test_orders_and_ends(spark):
    from quarry.functions import arrays
    from quarry.functions import text as T

    df = spark.createDataFrame([(1, ["a", "b", "c", "d"], "One. Two. Three.", [5, 6, 0, 0])], "k int, names array<string>, t string, ids array<int>")
    r = df.select(
        regions.shuffled(F.col("names"), F.col("k"), 3).alias("n"), T.shuffled_sentences(F.col("t"), F.col("k"), 3).alias("s"), arrays.ended(F.col("ids"), F.lit(2), 9).alias("e"), arrays.ended(F.col("ids"), F.lit(4), 9).alias("f")
    ).first()
    assert sorted(r.n) == ["a", "b", "c", "d"] and sorted(r.s.split(" ")) == ["One.", "Three.", "Two."] and r.e == [5, 6, 9, 0] and r.f == [5, 6, 0, 0]


def test_meteor_with_a_table_of_synonyms(spark):
    df = spark.createDataFrame([("the big nodule", "the large nodule")], "r string, h string")
    table = spark.createDataFrame([("big", "c1"), ("large", "c1"), ("large", "c2")], "word string, concept string")
    plain, full = (nlg.row_stats(df, "r", "h", t).first().meteor for t in (None, table))
    assert full == nlg.meteor(["the", "big", "nodule"], ["the", "large", "nodule"], synonyms={"big": "c1", "large": "c1"}) > plain
