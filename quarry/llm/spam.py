"""Keyword-stuffed and link-list pages.

Every page is turned into shares of its characters: links, tags, navigation, offers, repeated
phrases, digits, running text. Rules over these shares give weak labels and abstain in the middle.
Bagged decision trees are fitted to a bounded sample of the labelled pages and applied to all
pages; their scores are then shifted by the rate of such pages on the same host, shrunk towards the
rate of the whole corpus.

Parameters: ``SAMPLE`` bounds the rows that the trees are fitted to (the lowest hashes of
``doc_id``); everything else runs over all pages.

Defined results
    * null, empty and blank texts are no pages of this kind
    * a page without a host is judged by its own score
    * repeated rows come out once for every row; extra columns are ignored
    * if the rules label pages of one kind only, that is the answer for all
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.durable import cut
from quarry.plans.spread import spread

#: most labelled pages that the trees are fitted to
SAMPLE = 20_000
TREES, DEPTH, LEAF = 25, 6, 5
#: pages of the average host that a host's own rate is weighed against
PRIOR = 25.0
#: weight of the host in the log odds
HOST = 0.5

LINK = re.compile(r"""<a\s[^<>]*+>|</?(?:a|li|ul|ol|nav)\b[^<>]*+>|\[[^\[\]\n]++\]\([^)\s\[]{4,}+\)|(?:https?://|www\.)[^\s"'<>)\]]+|(?<![\w-])(?<![\w-]\.)(?:[\w-]++\.)++[a-z]{2,}+/[^\s"'<>)\]]*""", re.I)
TAG = re.compile(r"(?<!\w)#[^\W\d_][\w-]*")
#: a part of a trail has at most six words
_PART = r"[^\s>»›]++(?:[^\S\n]++[^\s>»›]++){0,5}+"
NAV = re.compile(
    rf"^(?:(?:{_PART}[^\S\n]++)?[>»›][^\S\n]++{_PART}[^\S\n]*+(?:[>»›][^\S\n]++{_PART}[^\S\n]*+)*+"
    r"|(?:tags?|related|categor(?:y|ies)|topics?|labels?|keywords?|see also|more about|read more|next|previous|prev|home|sitemap|search|menu|login|back)\b(?:\s+page)?(?:\s*:[^\n]*+|\s[^\n.!?]*+)?)$",
    re.I | re.M,
)
OFFER = re.compile(r"\b(?:sku|item|art)\.?\s*(?:no\.?\s*)?[:#]?\s*\d{3,}|\bin stock\b|\bfree shipping\b|\bsale\s*-?\d+\s*%|\brefurbished\b|\badd to (?:cart|basket)\b|[$€£]\s?\d", re.I)
#: one of these stands in every offer, or a number after ``art``
OFFERS = ("sku", "item", "in stock", "free shipping", "sale", "refurbished", "add to", "$", "€", "£")
_ART = re.compile(r"\bart\.?\s*(?:no\.?\s*)?[:#]?\s*\d")
WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
SPLIT = re.compile(r"[\n,;|/•»]+|(?<![.!?])[.!?]++\s+|(?<!\s)\s++[-–>]++\s+")
#: words that seldom belong to a search phrase (fixed list)
STOP = frozenset(
    "a about an and are as at be been before but by can cannot could did do does for from had has have he her his if in into is it its may no nor not of on or our over she should since so than that the their then there these they this to until was we were what when where which while who will with within without you your"
    " der die das ein eine und im in ist mit auf von zu den dem des nicht kein keine el la los las un una de del en y se no con por para le les des et du au aux est dans pas sur une ve bir için".split()
)
FEATURES = ("link", "links", "tag", "nav", "offer", "phrase", "repeat", "top", "distinct", "digit", "stop", "prose", "short", "length")


def describe(text: str) -> list[float]:
    """The features of one page, in the order of ``FEATURES``."""
    n = len(text)
    low = text.lower()
    # every link has one of these
    link_spans = [m.span() for m in LINK.finditer(text)] if "/" in text or "<" in text or "](" in text or "www." in low else []
    link = sum(e - s for s, e in link_spans)
    rest = " ".join(text[a:b] for a, b in zip([0, *(e for _, e in link_spans)], [*(s for s, _ in link_spans), n])) if link_spans else text
    tag = sum(map(len, TAG.findall(rest))) if "#" in rest else 0
    parts = [p for p in map(str.strip, SPLIT.split(rest)) if p]
    # no word reaches over the end of a part
    of_parts = [WORD.findall(p.lower()) for p in parts]
    words = list(chain.from_iterable(of_parts))
    k = len(words) or 1
    content = [w not in STOP for w in words]
    pairs = list(zip(words, words[1:]))
    keys = {p for p, c in Counter(pairs).items() if c >= 3 and p[0] not in STOP and p[1] not in STOP and not p[0][0].isdigit() and not p[1][0].isdigit()}
    stops = [i for i, c in enumerate(content) if not c and 0 < i < len(words) - 1]
    threes = Counter((words[i - 1], words[i + 1]) for i in stops)
    wide = {p for p, c in threes.items() if c >= 4 and p[0] not in STOP and p[1] not in STOP and not p[0][0].isdigit() and not p[1][0].isdigit()}
    covered = bytearray(len(words) + 1)
    if keys:
        for i, p in enumerate(pairs):
            if p in keys:
                covered[i] = covered[i + 1] = 1
    if wide:
        for i in stops:
            if (words[i - 1], words[i + 1]) in wide:
                covered[i - 1] = covered[i] = covered[i + 1] = 1
    same = Counter(p.lower() for p in parts)
    repeat = sum(len(p) * c for p, c in same.items() if c >= 3)
    counts = Counter([w for w in compress(words, content) if not w[0].isdigit()])
    top = sum(c for _, c in counts.most_common(4))
    nav = sum(len(m.group()) for m in NAV.finditer(text))
    near = [m.start() for m in OFFER.finditer(text)] if any(k in low for k in OFFERS) or _ART.search(low) else []
    offer = 0
    prose = short = 0
    for p, w in zip(parts, of_parts):
        if near and OFFER.search(p):
            offer += len(p)
        if len(w) >= 6 and not STOP.isdisjoint(w):
            prose += len(p)
        if len(w) <= 4:
            short += len(p)
    digits = sum(map(str.isdigit, rest))
    if len(near) >= 3:  # a list of offers: what lies between them belongs to it
        offer = max(offer, sum(b - a for a, b in zip(near, near[1:]) if b - a <= 90))
    return [
        link / n, len(link_spans) / (1 + n / 100), tag / n, nav / n, offer / n, sum(covered) / k, repeat / n, top / k, len(counts) / k,
        digits / n, (len(words) - sum(content)) / k, prose / n, short / n, float(np.log1p(n)),
    ]


def weak_label(f: list[float]) -> float | None:
    """1.0, 0.0 or, where the rules disagree or are unsure, None."""
    x = dict(zip(FEATURES, f))
    listed = x["link"] + 0.9 * (x["short"] if x["links"] > 0.6 else 0)
    marks = max(listed, x["tag"], x["nav"], x["offer"])
    stuffed = max(x["phrase"], x["repeat"])
    # clinical text repeats its terms as well, but between measurements
    plain = x["digit"] < 0.02
    if marks > 0.6 or (plain and stuffed > 0.45 and x["top"] > 0.2):
        return 1.0
    if marks < 0.3 and (not plain and x["offer"] < 0.2 and x["top"] < 0.35 or stuffed < 0.2):
        return 0.0
    return None


class Trees:
    """Bagged decision trees over quantile-binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        b = self.binned(x)
        rng = np.random.default_rng(seed)
        # both kinds weigh alike
        w = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        self.trees = []
        for _ in range(trees):
            pick = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(b[pick], y[pick], w[pick], depth, rng))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1)

    def _grow(self, b, y, w, depth, rng):
        total, pos = w.sum(), (w * y).sum()
        value = pos / total if total else 0.0
        if depth == 0 or len(y) < 2 * LEAF or value in (0.0, 1.0):
            return value
        best = (total * value * (1 - value) - 1e-9, None)
        # each split looks at a random two thirds of the features, so that the trees differ
        for j in rng.permutation(b.shape[1])[: max(1, 2 * b.shape[1] // 3)]:
            size = len(self.cuts[j]) + 1
            t, p, n = (np.cumsum(np.bincount(b[:, j], v, size)) for v in (w, w * y, np.ones(len(y))))
            with np.errstate(all="ignore"):
                left = p * (t - p) / t
                right = (pos - p) * ((total - t) - (pos - p)) / (total - t)
            cost = np.where((n >= LEAF) & (len(y) - n >= LEAF), np.nan_to_num(left) + np.nan_to_num(right), np.inf)
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], (int(j), k))
        if best[1] is None:
            return value
        j, k = best[1]
        go = b[:, j] <= k
        return j, k, self._grow(b[go], y[go], w[go], depth - 1, rng), self._grow(b[~go], y[~go], w[~go], depth - 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.zeros(len(b))

        def walk(node, rows):
            if not len(rows):
                return
            if isinstance(node, tuple):
                go = b[rows, node[0]] <= node[1]
                walk(node[2], rows[go])
                walk(node[3], rows[~go])
            else:
                out[rows] += node

        for t in self.trees:
            walk(t, np.arange(len(b)))
        return out / len(self.trees)


def features(pages: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fs = [describe(t) for t in b["text"]]
            yield pd.DataFrame({"page": b["page"], "host": b["host"], "f": fs, "weak": pd.Series([weak_label(f) for f in fs], dtype="float64")})

    cols = pages.select(pages[id_col].cast("long").alias("page"), pages[host_col].cast("string").alias("host"), pages[text_col].cast("string").alias("text"))
    return spread(cols.filter(r"text rlike '\\S'")).mapInPandas(each, "page long, host string, f array<double>, weak double")


def scores(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``<id_col>, host, score, smoothed`` of every page."""
    table = cut(features(pages, id_col, text_col, host_col), "features")
    labelled = table.filter("weak is not null and not isnan(weak)").select("f", "weak", F.xxhash64("page").alias("h"))
    rows = labelled.orderBy("h").limit(SAMPLE).select("f", "weak").toPandas()
    y = rows["weak"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        model = None
        constant = float(y.mean()) if len(y) else 0.0
    else:
        model, constant = Trees(np.stack(rows["f"].to_numpy()), y), 0.0

    @F.pandas_udf("double")
    def judged(f: pd.Series) -> pd.Series:
        if model is None or not len(f):
            return pd.Series([constant] * len(f), dtype="float64")
        return pd.Series(model.score(np.stack(f.to_numpy())))

    judgements = cut(table.select("page", "host", judged("f").alias("score")), "scores")
    rate = judgements.agg(F.avg("score")).first()[0] or 0.0
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    hosts = (
        judgements.filter("host is not null")
        .groupBy("host")
        .agg(((F.sum("score") + PRIOR * rate) / (F.count(F.lit(1)) + PRIOR)).alias("rate"))
    )
    odds = lambda c: F.log(c / (1 - c))
    own = F.least(F.greatest(F.col("score"), F.lit(0.005)), F.lit(0.995))
    host = F.coalesce("rate", F.lit(rate))
    z = odds(own) + HOST * (odds(F.least(F.greatest(host, F.lit(1e-3)), F.lit(1 - 1e-3))) - float(np.log(rate / (1 - rate))))
    return judgements.join(hosts, "host", "left").select(F.col("page").alias(id_col), "host", "score", (1 / (1 + F.exp(-z))).alias("smoothed"))


def spam_pages(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = 0.5) -> DataFrame:
    return scores(pages, id_col, text_col, host_col).filter(F.col("smoothed") > threshold).select(id_col)
