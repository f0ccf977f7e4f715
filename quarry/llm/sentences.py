"""Sentence units of texts in any script, as character spans.

Document-centred disambiguation of the period. A word's unambiguous uses in its own text come first:
twice or more before a period, always followed by lower case or a digit, and never without the
period, it is an abbreviation; also without a period, and never followed by lower case or a digit, it
is none. After an abbreviation a capitalised word that the text has in lower case, too, opens a
sentence; one that stands capitalised inside sentences is a name and opens none. A text that goes on
in lower case after most periods, and words all in capitals, show nothing of the kind. Where the text
is silent or contradicts itself, the corpus decides: a first pass counts, for every word that stands before a
period, how it goes on (lower case, digit, capital, end of text) and, for every word, how often it
opens a text. Scripts bring their own terminators (danda, ideographic stop, Arabic question mark,
blank between Thai letters).

The word tables keep only words above a relative frequency floor, so they hold at most
``1 / FLOOR`` entries at any corpus size and may be sent to every task; rarer words are left to the
texts themselves.

Defined results
    * null, empty, blank texts and texts without letters and digits have no units
    * spans count code points, exclude outer white space, do not overlap, and rise in order
    * repeated rows come out once for every row; extra columns are ignored
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.durable import cut
from quarry.plans.spread import spread

#: words rarer than this share of all words get no verdict from the corpus
FLOOR = 1e-5
#: least number of uses before a period for a verdict
LEAST = 8

HARD = re.compile(r"[Tt][Hh][Ee]\s+[Rr][Ee][Gg][Ii][Oo][Nn]\s+\d+\s+[Ii][Ss]\s+[A-Za-z]+(?:\s+[A-Za-z]+){0,3}\s*:|(?:\r?\n[^\S\n]*){2,}")
EVENT = re.compile(r"[.!?…。！？।॥؟۔]+|[\"“„«「『]|(?<=[฀-๿])\s+(?=[฀-๿])|\n")
ASCII_EVENT = re.compile(r"[.!?]+|[\"\n]")
CLOSERS = {'"': '"', "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』"}
ENDS = frozenset(".!?…。！？।॥؟۔")
OPENERS = frozenset("\"“„«「『¿¡([")
WORD = re.compile(r"[^\W\d_]+")
ITEM = re.compile(r"\s*\(?\d{1,3}\Z")
ITEM_AHEAD = re.compile(r"\s*(?:\(?\d{1,2}[.)]\s|[-*•]\s)")


_BLANK = re.compile(r"\n[^\S\n]*(?:\r?\n[^\S\n]*)+")


@lru_cache(64)
def hard(text: str) -> list[tuple[int, int]]:
    """The spans of all matches of ``HARD``, looked for at the word "region" and at line feeds only."""
    low = text.lower()
    if len(low) != len(text):
        return [m.span() for m in HARD.finditer(text)]
    out, at = [], low.find("region")
    while at >= 0:
        k = at
        while k > 0 and text[k - 1].isspace():
            k -= 1
        if k < at and low[max(k - 3, 0) : k] == "the" and (m := HARD.match(text, k - 3)):
            out.append(m.span())
        at = low.find("region", at + 6)
    if text.count("\n") > 1:
        blank = [(s - (text[s - 1 : s] == "\r"), e) for s, e in (m.span() for m in _BLANK.finditer(text))]
        if blank and out:  # a header may hold blank lines
            out.sort()
            starts = [s for s, _ in out]
            blank = [x for x in blank if (i := bisect_right(starts, x[0])) == 0 or out[i - 1][1] <= x[0]]
        out = sorted(out + blank)
    return out


def segments(text: str) -> list[tuple[int, int, bool]]:
    """Parts between region headers and blank lines, with the headers themselves (marked)."""
    out, at = [], 0
    for s, e in hard(text):
        out.append((at, s, False))
        if not text[s:e].isspace():
            out.append((s, e, True))
        at = e
    out.append((at, len(text), False))
    return out


def count_words(texts: Iterable[tuple[str, int]]) -> tuple[dict[str, list[int]], Counter]:
    """Uses before a period by word: [all, goes on, at the end]; and uses of words, with openers
    counted under a leading NUL. A text comes with the number of its copies."""
    dots: dict[str, list[int]] = {}
    words: Counter = Counter()
    for text, copies in texts:
        for s, e, header in segments(text):
            if header:
                continue
            part = text[s:e]
            ws = part.split()
            if not ws:
                continue
            low = part.lower().split()
            if copies == 1:
                words.update(low)
            else:
                for w in low:
                    words[w] += copies
            words["\0" + low[0]] += copies
            last = len(ws) - 1
            for i in [i for i, w in enumerate(ws) if w[-1] in ".?!"]:
                w = ws[i]
                if w[-1] != ".":
                    if i < last:
                        words["\0" + low[i + 1]] += copies
                    continue
                t = low[i].rstrip(".").lstrip("([\"“«„¿")
                if not t or not t[-1].isalpha() or w.endswith(".."):
                    continue
                c = dots.get(t)
                if c is None:
                    c = dots[t] = [0, 0, 0]
                c[0] += copies
                if i == last:
                    c[2] += copies
                else:
                    n = ws[i + 1][0]
                    if n.islower() or n.isdigit() or n in ",;":
                        c[1] += copies
    return dots, words


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``word, dots, goes_on, at_end, uses, opens`` over every row of the one-column ``texts``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dots: dict[str, list[int]] = {}
        words: Counter = Counter()

        def rows() -> pd.DataFrame:
            got = [(w, *c, 0, 0) for w, c in dots.items()]
            got += [(w[1:], 0, 0, 0, 0, n) if w[0] == "\0" else (w, 0, 0, 0, n, 0) for w, n in words.items()]
            return pd.DataFrame(got, columns=["word", "dots", "goes_on", "at_end", "uses", "opens"])

        for b in batches:
            d, w = count_words(Counter(x for x in b.iloc[:, 0] if x).items())
            for k, v in d.items():
                c = dots.setdefault(k, [0, 0, 0])
                for i in range(3):
                    c[i] += v[i]
            words.update(w)
            if len(words) > 500_000:  # only memory: the counts are added up after the shuffle
                yield rows()
                dots, words = {}, Counter()
        yield rows()

    got = spread(texts).mapInPandas(each, "word string, dots long, goes_on long, at_end long, uses long, opens long")
    return got.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("dots", "goes_on", "at_end", "uses", "opens")))


class Verdicts:
    """What the corpus says of words: abbreviations, ordinary last words, shares of openings."""

    def __init__(self, rows: list[tuple]):
        self.abbreviation: dict[str, bool] = {}
        self.opens: dict[str, float] = {}
        for word, dots, goes_on, at_end, uses, opens in rows:
            if dots >= LEAST:
                # a title before names goes on with capitals, yet closes no text and hardly occurs bare
                title = len(word) <= 3 and at_end < 0.015 * dots and uses < 0.2 * dots
                self.abbreviation[word] = goes_on > 0.5 * dots or title
            if uses:
                self.opens[word] = min(1.0, opens / uses)


def verdicts(texts: DataFrame) -> Verdicts:
    counts = cut(corpus_counts(texts), "words")
    total = counts.agg(F.sum("uses")).first()[0] or 0
    kept = counts.filter(F.greatest("uses", "dots") >= total * FLOOR)
    return Verdicts([tuple(r) for r in kept.select("word", "dots", "goes_on", "at_end", "uses", "opens").collect()])


class Uses:
    """How one text uses its words: before a period (all, before lower case, before a digit), without
    one, and capitalised inside sentences."""

    def __init__(self, text: str):
        ws = self.words = text.split()
        self.dots: dict[str, tuple[int, int, int]] = {}
        low = high = 0
        for i in [i for i, w in enumerate(ws) if w[-1] == "."]:
            t = ws[i][:-1].lstrip(_BEFORE)
            n = ws[i + 1][0] if i + 1 < len(ws) else " "
            a, b, c = self.dots.get(t, (0, 0, 0))
            self.dots[t] = a + 1, b + n.islower(), c + n.isdigit()
            low, high = low + n.islower(), high + n.isupper()
        self.lengths = set(map(len, self.dots))
        #: do sentences of this text begin with capitals?
        self.cased = low <= 0.4 * (low + high)

    @cached_property
    def bare(self) -> set[str]:
        return {w.strip(_AROUND) for w in set(self.words) if w[-1] != "."}

    @cached_property
    def inside(self) -> set[str]:
        pairs = zip(self.words, self.words[1:])
        return {w.strip(_AROUND) for before, w in pairs if w[0].isupper() and w[-1] != "." and before[-1] not in _ENDING}


_BEFORE = "([\"“„«¿¡>"
_AROUND = "([\"“„«¿¡>,;:!?)]”»"
_ENDING = frozenset(".!?…。！？।॥؟۔:\"”»")


class Splitter:
    def __init__(self, v: Verdicts):
        self.abbreviation, self.opens = v.abbreviation, v.opens
        self.lengths = set(map(len, v.abbreviation))
        self._text: str | None = None
        self._uses: Uses | None = None
        self._token = (0, 0)

    def spans(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, e, header in segments(text):
            if header:
                out.append((s, e))
            elif e > s:
                self._segment(text, s, e, out)
        return out

    def _emit(self, text: str, s: int, e: int, first: int, out: list) -> None:
        """``first``: number of spans before this segment; a piece of marks only joins the span before it."""
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s >= e:
            return
        if text[s].isalnum() or any(map(str.isalnum, text[s:e])):
            out.append((s, e))
        elif len(out) > first:
            out[-1] = (out[-1][0], e)

    def _segment(self, text: str, s: int, e: int, out: list) -> None:
        first, at, skip = len(out), s, s
        self._token = (s, s)
        for m in (ASCII_EVENT if text.isascii() else EVENT).finditer(text, s, e):
            i = m.start()
            if i < skip:
                continue
            c = text[i]
            end = m.end()
            if c in CLOSERS:
                close = CLOSERS[c]
                j = min((k for k in (text.find(x, i + 1, e) for x in close) if k > 0), default=-1)
                if j < 0:
                    break  # the closing mark is lost: the quotation reaches the end of its segment
                skip = j + 1
                inner = text[i + 1 : j].rstrip()
                if not inner or inner[-1] not in ENDS:
                    continue
                if self._after_quote(text, at, i, j + 1, e):
                    self._emit(text, at, j + 1, first, out)
                    at = j + 1
                continue
            if c == "\n":
                if ITEM_AHEAD.match(text, i, e) and text[at:i].strip():
                    self._emit(text, at, i, first, out)
                    at = i
                continue
            if c.isspace():
                self._emit(text, at, i, first, out)
                at = end
                continue
            while end < e and text[end] in ")]”»」』’":
                end += 1
            if text[i : m.end()] == ".":
                ends = self._period(text, s, at, i, end, e)
            elif c in ".…" and text[i : m.end()].strip(".…") == "":
                before = text[i - 1] if i > s else " "
                ends = not before.isspace() and before not in "[(" and self._starts(text, end, e, 0.3)
            else:
                ends = end == m.end() or self._starts(text, end, e, 0.05)
            if ends:
                self._emit(text, at, end, first, out)
                at = end
            skip = end
        self._emit(text, at, e, first, out)

    def _after_quote(self, text: str, at: int, q: int, k: int, e: int) -> bool:
        """Does the sentence end with the quotation that closed just before ``k``?"""
        while k < e and text[k].isspace():
            k += 1
        if k >= e:
            return True
        n = text[k]
        if n in ".,;:!?)。，、،":
            return False
        before = text[at:q].rstrip()
        if before[-1:] in (":", "："):
            return True
        if "぀" <= n <= "ゟ":
            return False
        if n.isdigit() or n in OPENERS:
            return True
        return self._starts(text, k, e, 0.05)

    def _starts(self, text: str, k: int, e: int, unknown: float) -> bool:
        """May the word at ``k`` open a sentence? ``unknown``: least share of openings asked of
        lower-case words."""
        while k < e and text[k].isspace():
            k += 1
        if k >= e:
            return True
        n = text[k]
        if not n.isalpha():
            return n in OPENERS or n.isdigit()
        j = k
        while j < e and not text[j].isspace():
            j += 1
        p = self.opens.get(text[k:j].lower())
        if p is None:
            return not n.islower()
        return p >= (unknown if n.islower() else 0.02)

    def uses(self, text: str) -> Uses:
        """Gathered once for each text, and only if a word asks for it."""
        if self._text is not text:
            self._text, self._uses = text, Uses(text)
        return self._uses

    def _is_abbreviation(self, text: str, t: str) -> bool | None:
        own = self.uses(text)
        if own.cased:
            n, lower, digit = own.dots.get(t, (0, 0, 0))
            if lower and n > 1 and lower + digit == n and t not in own.bare:
                return True
            if n and not lower and not digit and len(t) > 1 and not t.isupper() and t in own.bare:
                return False
        low = t.lower()
        v = self.abbreviation.get(low)
        if v is not None:
            return v
        return True if "." in low or len(low) == 1 else None

    def _opens_after_abbreviation(self, text: str, k: int, e: int) -> bool:
        """Does the text itself show that the capitalised word at ``k`` is no name?"""
        j = k
        while j < e and text[j].isalnum():
            j += 1
        word, own = text[k:j], self.uses(text)
        low = word.lower()
        return own.cased and word[1:].islower() and word not in own.inside and low in own.bare and self.opens.get(low, 1.0) >= 0.02

    def _word_before(self, text: str, at: int, i: int) -> int:
        """Where the token before the period at ``i`` begins. Periods come in order, so that every
        character is looked at once."""
        start, seen = self._token
        low = seen if at <= start and seen <= i else at
        j = i
        while j > low and not text[j - 1].isspace() and text[j - 1] not in _BEFORE:
            j -= 1
        if j > low or low == at:
            start = j
        self._token = (start, i)
        return start

    def _period(self, text: str, s: int, at: int, i: int, end: int, e: int) -> bool:
        if i == s:
            return False
        p = text[i - 1]
        k = end
        while k < e and text[k].isspace():
            k += 1
        if k >= e:
            return True
        n, spaced = text[k], k > end
        if n in ",;:)-/%=]":
            return False
        if p.isdigit():
            if not spaced and (n.isdigit() or n.islower()):
                return False
            if ITEM.match(text[at:i]):
                return False
            if n.isdigit() or n in OPENERS:
                return True
            if n.isalpha():
                if not spaced and not n.isupper() and n.lower() != n.upper():
                    return False
                return self._starts(text, k, e, 0.05)
            return True
        if not p.isalpha() and not ("ऀ" <= p <= "๿"):
            return spaced or n.isupper() or n.isdigit() or n in OPENERS or n.lower() == n.upper()
        if "ऀ" <= p <= "๿":  # the period closes no sentence in these scripts
            return False
        start = self._word_before(text, at, i)
        short = i - start == 1
        if i - start not in self.lengths and i - start not in self.uses(text).lengths:  # in no table
            v = True if short or text.find(".", start, i) >= 0 else None
        else:
            v = self._is_abbreviation(text, text[start:i])
        if v:
            return spaced and n.isupper() and not short and self._opens_after_abbreviation(text, k, e)
        if spaced:
            if n.islower():
                return v is False and self._starts(text, k, e, 0.01) or self._starts(text, k, e, 0.05)
            return True
        if n.isupper() or n in OPENERS:
            return not short
        if n.isdigit():
            return v is False
        if n.islower():
            return v is False and self._starts(text, k, e, 0.2)
        return n.isalpha()


def sentence_spans(df: DataFrame, id_col: str, text_col: str, v: Verdicts) -> DataFrame:
    """``rec_id, start_pos, end_pos``: one row for each unit of each text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Splitter(v)
        for b in batches:
            ids, starts, ends = [], [], []
            for k, text in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if text:
                    got = split.spans(text)
                    ids += [k] * len(got)
                    starts += [x[0] for x in got]
                    ends += [x[1] for x in got]
            yield pd.DataFrame({"rec_id": pd.Series(ids, dtype="int64"), "start_pos": pd.Series(starts, dtype="int64"), "end_pos": pd.Series(ends, dtype="int64")})

    cols = df.select(df[id_col].cast("long").alias("rec_id"), df[text_col].cast("string").alias("text")).filter("text is not null")
    return spread(cols).mapInPandas(each, "rec_id long, start_pos long, end_pos long")


def found(spark_tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``tbl, rec_id, start_pos, end_pos`` for several tables that share one corpus of counts."""
    corpus = None
    for df, _, text in spark_tables.values():
        one = df.select(df[text].cast("string").alias("text")).filter("text is not null")
        corpus = one if corpus is None else corpus.unionByName(one)
    v = verdicts(corpus)
    out = None
    for name, (df, key, text) in spark_tables.items():
        part = sentence_spans(df, key, text, v).select(F.lit(name).alias("tbl"), "rec_id", "start_pos", "end_pos")
        out = part if out is None else out.unionByName(part)
    return out
