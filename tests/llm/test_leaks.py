"""Leak search against brute force."""

import random

from quarry.llm import leaks


def brute(docs, items):
    runs = {}
    for i, t in items:
        w = leaks.normal_words(t or "")
        for k in range(len(w) - leaks.RUN + 1):
            runs.setdefault(tuple(w[k : k + leaks.RUN]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.normal_words(t or "")
        for k in range(len(w) - leaks.RUN + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + leaks.RUN]), ())}
    return out


def test_words():
    assert leaks.normal_words("É­tu​de, Größe_x (3.5)") == ["etude", "grosse", "x", "3", "5"]


def test_against_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, text(rnd.randint(5, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 " * 30)]
    docs = []
    for d in range(120):
        body = text(rnd.randint(0, 60))
        if rnd.random() < 0.5:
            w = (rnd.choice(items)[1] or "").split()
            k = rnd.randint(0, max(0, len(w) - 13))
            n = rnd.choice([11, 12, 13])
            body += " " + rnd.choice([", ", " \n> "]).join(x.upper() for x in w[k : k + n]) + " " + text(5)
        docs.append((d, body))
    docs += [(200, None), (201, ""), (202, "w1 " * 5000), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, words int")
    it = spark.createDataFrame([(i, t, "test") for i, t in items], "item_id long, text string, split string")
    got = leaks.passages(df, it)
    want = brute(docs, items)
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)
    n = {r.item_id: r.n_docs for r in leaks.leaked_items(got, it).collect()}
    assert n == {i: sum(x == i for _, x in want) for i, _ in items}
    assert want <= {tuple(r) for r in leaks.proximity(df, it).collect()}
    assert leaks.passages(df.limit(0), it).count() == 0 and leaks.passages(df, it.limit(0)).count() == 0


def test_proximity_bears_changes(spark):
    w = [f"u{i}" for i in range(40)]
    changed = w[:5] + ["extra"] + w[5:9] + ["other"] + w[10:]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(reversed(w)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert [tuple(r) for r in leaks.proximity(docs, items).collect()] == [(1, 1)]


def test_proximity_bears_changes_of_rare_words(spark):
    """The changed words may be the rarest ones, and the new ones may stand nowhere else."""
    w = [f"u{i}" for i in range(15)]
    rare = w[:7] + ["rare", "seldom"] + w[9:]
    changed = w[:7] + ["new", "fresh"] + w[9:]
    docs = [(1, " ".join(changed)), (2, "rare seldom"), (3, " ".join(w[:7] + ["a", "b", "c"] + w[10:]))]
    docs += [(10 + i, " ".join(reversed(w))) for i in range(5)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(rare)), (2, " ".join(w[:7] + ["absent"] + w[8:]))], "item_id long, text string")
    assert sorted(tuple(r) for r in leaks.proximity(docs, items).collect()) == [(1, 1), (1, 2)]


def near_brute(docs, items, slack=3, near=10):
    out = set()
    for (d, t), (i, u) in ((x, y) for x in docs for y in items):
        a, b = leaks.normal_words(t or ""), leaks.normal_words(u or "")
        for s in range(len(b) - leaks.RUN + 1):
            places = {}
            for k in range(s, s + leaks.RUN):
                for p, w in enumerate(a):
                    if w == b[k]:
                        q = (p - k) // slack
                        for place in (q, q + 1):
                            places.setdefault(place, set()).add(k)
            if any(len(x) >= near for x in places.values()):
                out.add((d, i))
    return out


def test_one_index_answers_several_item_sets(spark, monkeypatch):
    """Small segments, pieces and blocks give the same as large ones; the corpus is indexed once."""
    monkeypatch.setattr(leaks, "SEGMENT", 300)
    monkeypatch.setattr(leaks, "PIECE", 20)
    monkeypatch.setattr(leaks, "BLOCK", 150)
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: rnd.choices(vocabulary, k=n)
    items = [(i, text(rnd.randint(5, 70))) for i in range(12)]
    docs = []
    for d in range(60):
        w = rnd.choice(items)[1]
        k, n = rnd.randint(0, len(w)), rnd.choice([11, 12, 13, 20])
        part = w[k : k + n]
        for _ in range(rnd.choice([0, 0, 1, 2]) if part else 0):
            part[rnd.randrange(len(part))] = rnd.choice(["changed", "w3"])
        docs.append((d, " ".join(text(rnd.randint(0, 30)) + part + text(8))))
    items = [(i, " ".join(w)) for i, w in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = leaks.Index(df)
    for part in (items[:6], items[6:], items):
        it = spark.createDataFrame(part, "item_id long, text string")
        want, wide = brute(docs, part), near_brute(docs, part)
        assert {tuple(r) for r in leaks.passages(df, it, index).collect()} == want
        assert {tuple(r) for r in leaks.proximity(df, it, index).collect()} == wide
    assert len(wide) > len(want) > 5
