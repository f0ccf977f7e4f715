"""Defect labels and page classification."""

import random

import numpy as np

from quarry.llm import pairs, spam
from quarry.llm.labelmodel import LabelModel, cutoff


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    acc, speak = [0.95, 0.85, 0.75], [0.9, 0.6, 0.8]
    votes = np.stack([np.where(rng.random(len(y)) < s, np.where(rng.random(len(y)) < a, y, ~y), -1) for a, s in zip(acc, speak)], axis=1).astype(int)
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    m = LabelModel([0.8, 0.8, 0.8], 0.05).fit(pats, counts.astype(float))
    assert abs(m.pi - 0.1) < 0.03 and m.rates[1][0] > 0.85 and m.rates[0][0] < 0.1
    p = m.posterior(votes)
    at, truth = np.concatenate([pats, pats]), np.repeat([True, False], len(pats))
    n = np.array([((votes == v).all(axis=1) & (y == t)).sum() for v, t in zip(at, truth)], float)
    cut = cutoff(m.posterior(at), truth, n, 0.1)
    assert ((p >= cut.at) == y).mean() > 0.95 and cut.precision > 0.7 and cut.recall > 0.8
    assert cutoff(np.zeros(0), np.zeros(0, bool), np.zeros(0), 0.1).at == 0.5
    assert m.posterior(np.array([[-1, -1, -1]]))[0] == np.float64(m.pi) or abs(m.posterior(np.array([[-1, -1, -1]]))[0] - m.pi) < 1e-9


def test_languages():
    assert pairs.question_language("Describe all findings of this chest CT. Please answer in German.") == "de"
    assert pairs.question_language("Que montre la région heart ?") == "fr"
    assert pairs.question_language("Was zeigt die Untersuchung im Bereich lung?") == "de"
    assert pairs.question_language("请描述所有发现。") == "zh" and pairs.question_language("この所見を記述してください。") == "ja"
    assert pairs.script("123 ()") is None


def test_defects(spark):
    rnd = random.Random(8)
    ends = ["The lung is clear", "The heart is of normal size", "There is no nodule in the left lobe", "A nodule of 3 mm lies in the right lobe, see image 4"]
    de = ["Die Lunge ist frei", "Das Herz ist nicht vergrößert", "Kein Rundherd im linken Oberlappen", "Ein Herd mit 3 mm auf Bild 4 ist im Lappen und mit der Pleura verbunden"]
    q, qd = "Describe all findings of this chest CT.", "Bitte beschreiben Sie alle Befunde dieser Aufnahme."
    make = lambda xs: ". ".join(rnd.choices(xs, k=rnd.randint(3, 7))) + "."
    rows = [(i, q, make(ends), make(ends)) for i in range(400)] + [(400 + i, qd, make(de), make(de)) for i in range(200)]
    g = make(ends)
    bad = {
        1000: (None, "empty"), 1001: (" ", "empty"), 1002: ("N/A", "empty"), 1003: ("The region 0 is lung: The region 1 is heart:", "empty"),
        1010: ("I'm sorry, but I can't help with that.", "refusal"), 1011: ("As a language model, I cannot give a diagnosis.", "refusal"),
        1020: (q, "copies_question"), 1021: ("Question: " + q.lower() + " " + q, "copies_question"),
        1030: (make(de) + " " + make(de), "wrong_language"),
        1040: ("The lung is clear. There is no nodule in the le", "truncated"), 1041: ("The lung is clear. A nodule of 3 mm (see image", "truncated"),
        1050: ("Sorry for the late report. " + make(ends), None), 1051: ('You asked: "' + q + '" ' + make(ends), None),
    }
    rows += [(k, q, a, g) for k, (a, _) in bad.items()]
    rows += [(2000, None, make(ends), None), (2001, None, None, None), (1000, q, None, g)]
    df = spark.createDataFrame(rows, "sample_id long, Question string, Pred_combined_report string, GT_combined_report string").selectExpr("*", "1 AS id", "'x' AS answer")
    got = sorted((r.sample_id, r.defect) for r in pairs.defects(df.drop("id", "answer")).collect())
    assert got == sorted([(k, d) for k, (_, d) in bad.items() if d] + [(1000, "empty"), (2001, "empty")])
    assert pairs.defects(df.limit(0)).count() == 0
    lab = {(r.sample_id, r.defect) for r in pairs.labels(df).collect()}
    assert set(got) <= lab
    cuts = {r.defect: r for r in pairs.cutoffs(df).collect()}
    assert set(cuts) == set(pairs.DEFECTS)
    assert [(d, r.cutoff, r.recall) for d, r in cuts.items() if not (0 < r.cutoff < 1 and r.recall > 0.7)] == []


SCRIPTED = {
    "ru": "Лёгкие чистые, узлов нет.", "zh": "双肺清晰，未见结节。", "ja": "両肺に結節はありません。", "ar": "الرئتان صافيتان ولا توجد عقيدات.",
    "hi": "फेफड़े साफ हैं और कोई गाँठ नहीं है।", "th": "ปอดใสไม่พบก้อน", "ko": "폐는 깨끗하고 결절이 없습니다.", "de": "Die Lunge ist frei und das Herz ist nicht vergrößert.",
    "fr": "Les poumons sont clairs et le coeur est normal.", "es": "Los pulmones están claros y el corazón es normal.",
}


def test_every_script_is_another_language(spark):
    """An answer in another script is in another language, whatever the word profiles know."""
    rnd = random.Random(2)
    q = "Describe all findings of this chest CT."
    ends = ["The lung is clear", "The heart is of normal size", "There is no nodule in the left lobe", "A nodule of 3 mm lies in the right lobe"]
    make = lambda: ". ".join(rnd.choices(ends, k=rnd.randint(3, 7))) + "."
    rows = [(i, q, make(), make()) for i in range(300)]
    foreign = [(1000 + i, q, f"The region 0 is lung: {t} {t}", make()) for i, (lang, t) in enumerate(SCRIPTED.items()) if pairs.script(t) != "latin"]
    right = [(2000 + i, q + f" Please answer in {name.capitalize()}.", f"{t} {t} 3 mm.", make()) for i, (name, t) in enumerate((n, SCRIPTED[c]) for n, c in pairs.ASKED.items() if c in SCRIPTED and n.isascii() and n in ("russian", "chinese", "japanese", "arabic", "hindi", "thai", "korean"))]
    got = {r.sample_id: r.defect for r in pairs.defects(spark.createDataFrame(rows + foreign + right, "sample_id long, Question string, Pred_combined_report string, GT_combined_report string")).collect()}
    assert len(foreign) == 7 and {k: d for k, d in got.items() if 1000 <= k < 2000} == {r[0]: "wrong_language" for r in foreign}
    assert "wrong_language" not in {d for k, d in got.items() if k >= 2000 or k < 1000}


def test_scripts():
    assert [pairs.script(t) for t in SCRIPTED.values()] == ["ru", "zh", "ja", "ar", "hi", "th", "ko", "latin", "latin", "latin"]
    assert pairs.script("a" * 500 + "ж" * 400) == "ru" and pairs.script("a" * 500 + "ж" * 100) == "latin"


def test_validation_rows():
    sample = [("Describe all findings of this chest CT.", "The lung is clear. " * 12), ("Bitte beschreiben Sie alle Befunde.", "Die Lunge ist frei. " * 12)]
    made = pairs.validation_rows(sample)
    assert [x[2] for x in made[:6]] == ["none", "empty", "copies_question", "refusal", "truncated", "wrong_language"]
    assert made[5][1] == sample[1][1] and pairs.validation_rows([]) == []


def test_closing_words_of_any_length():
    from quarry.llm import truncation as tr

    long = "pneumono" * 100
    unit = f"Some words stand before {long} {long} {long} {long}."
    assert tr.closings(unit) == tr.closings("Other words before it: " + unit) and tr.tail(unit, 2) == [long, "."]
    assert tr.tail("a 3x4 b", 2) == ["#", "b"] and tr.tail("", 4) == []


def test_odd_long_texts():
    from quarry.llm.sentences import Verdicts
    from quarry.llm.truncation import Judge

    judge, profile = Judge(Verdicts([])), pairs.Profile([])
    for t in (" " * 200_000 + "x", "." * 200_000 + "x", "x." * 100_000, "<a " * 50_000, "[" * 50_000, "a-" * 100_000, "# " * 50_000, "a > " * 50_000, "the region 0 is " * 20_000):
        assert len(spam.describe(t)) == len(spam.FEATURES)
        judge.verdict(t, judge.split.spans(t))
        pairs.static_votes(t, t, profile)


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.7) | (x[:, 3] + x[:, 4] > 1.5)).astype(float)
    t = spam.Trees(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95


def test_spam_pages(spark):
    rnd = random.Random(3)
    keys = ["cheap scan", "scan price", "chest test", "book online"]
    prose = ["The nodule in the left lobe measures {} mm on image {} and was not seen before.", "We compare the report of day {} with the one of day {} because they differ.", "No effusion was found in the {} readings that were reviewed in week {}."]
    article = lambda: " ".join(rnd.choice(prose).format(rnd.randint(1, 90), rnd.randint(1, 400)) for _ in range(rnd.randint(5, 12)))
    links = lambda n: "\n".join(f"{rnd.choice(keys).title()} -> http://site{rnd.randint(1, 99)}.example/p/x{rnd.randint(100, 999)}" for _ in range(n))
    rows = [(i, article(), f"h{i % 7}") for i in range(300)]
    rows += [(1000 + i, links(20), "h1") for i in range(20)]
    rows += [(1100 + i, ", ".join(rnd.choices(keys, k=40)), None) for i in range(20)]
    rows += [(1200 + i, " ".join("#" + rnd.choice(keys).replace(" ", "-") for _ in range(40)), "h2") for i in range(20)]
    rows += [(2000 + i, article() + "\n\nLinks:\n" + links(2), "h3") for i in range(20)]
    rows += [(3000, None, "h1"), (3001, "", "h1"), (3002, " ", "h1"), (1000, rows[300][1], "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS page", "2 AS host")
    got = [r.doc_id for r in spam.spam_pages(df).collect()]
    assert sorted(got) == sorted([*range(1000, 1020), *range(1100, 1120), *range(1200, 1220), 1000])
    assert spam.spam_pages(df.limit(0)).count() == 0
    assert spam.spam_pages(df.filter("doc_id < 300")).count() == 0


def test_profile_reads_whole_answers(spark):
    """The script of an answer is that of all its text without headers, not of its first characters."""
    from quarry.llm import pairs

    q = "Describe the findings in the lung and answer in English."
    rows = [(q, "лёгкие чистые " * 40 + "plain words " * 200)] + [(q, "The region 0 is lung: " * 30 + "лёгкие чистые " * 60)]
    p = pairs.profile(spark.createDataFrame(rows, "question string, answer string"))
    assert "plain" in p.places
    p = pairs.profile(spark.createDataFrame(rows[1:], "question string, answer string"))
    assert not p.places


def test_links_and_tags_of_any_length():
    """Long attributes, domains, tag lines and trails count like short ones."""
    share = lambda t, f: spam.describe(t)[spam.FEATURES.index(f)]
    for n in (20, 200, 600, 5000):
        assert share(f'<a href="http://a.example/{"x" * n}">key</a> ' * 5, "link") > 0.8
        assert share(f"[{'key ' * n}](http://a.example/x) " * 3, "link") > 0.9
    for n in (10, 40, 400):
        assert share("Tags: " + "chest scan, " * n, "nav") > 0.9
        assert share(" > ".join(["Chest"] * n), "nav") > 0.9
    assert share("see " + ".".join(["a" * 80] * 9) + ".example/x", "link") > 0.9
    assert share("Next we compare both lungs with care. They differ.", "nav") == 0
    for t in ("ART12345 ", "ARTNO99812 ", "art. no. 123 ", "SKU: 991 "):
        assert share(t * 4, "offer") > 0.7, t


def test_triples_of_a_word_are_looked_up_once_for_a_question(monkeypatch):
    question, calls = pairs.Asked("Describe the lung of the patient"), []
    monkeypatch.setattr(pairs, "triples", lambda w, f=pairs.triples: calls.append(w) or f(w))
    ws = ["the", "lung", "is", "clear", "the", "lung"] * 3
    of_words = [x for w in ws for x in pairs.triples.__defaults__[0](w)]
    assert question.within(ws) == sum(x in question.triples for x in of_words) / len(of_words)
    assert sorted(calls) == ["clear", "is", "lung", "the"]
    assert question.found(ws) == len(question.triples.intersection(of_words)) / len(question.triples)
