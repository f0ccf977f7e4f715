"""Texts that lost their end.

Near-copies are found by minwise bands over openings of 5, 10, 20, ... words up to the whole text (a
cut copy shares its opening with the whole text, not its length): a text is looked up by the longest
opening before its last word, under which every longer copy is filed too. A candidate must hold the
text's last full word, followed by the same first character, near the place where the text ends; this
is tested by a bit in the band join and by a hash of every such place afterwards, and drops nothing
that the alignment would accept. The rest are aligned word by word. Where one copy's alignment ends
while the other goes on inside a word or a sentence, that copy is cut; where it ends at the end of a
sentence, it is whole. Texts without such a copy are judged by how they close: an unclosed bracket,
quotation or region header, a mark of omission, or closing words that seldom end the finished
sentences of the corpus.

Defined results
    * null, empty, blank texts, placeholders and texts of headers only are no cases
    * a text that lacks only its final stop is no case, nor one that ends with a finished sentence
    * every row and field comes out on its own; repeated rows repeat
    * extra columns are ignored
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import batched, chain, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.llm import nearcopies as nc
from quarry.llm.sentences import CLOSERS, HARD, Splitter, Verdicts, hard, verdicts
from quarry.plans.durable import cut
from quarry.plans.spread import spread

#: words of the shortest opening, each further one being twice as long, and the sketch of its shingles
HEAD, SHINGLE, BANDS, ROWS = 5, 3, 8, 3
#: share of words in which the aligned part of a copy may differ
SHARE = 0.1
#: finished sentences with the same last four words (of three words: thrice as many) for each different
#: text, and the least number of them in a small corpus
RATE, SEEN = 2e-5, 2
#: placeholders and other texts that state nothing (fixed list)
NOTHING = frozenset("nan none null n/a na n.a nil unk <unk> answer report findings response output - -- . .. ? [] {} () \"\" '' tbd".split())

OMISSION = re.compile(r"(?:\[\s*(?:\.{2,}+|…)\s*\]|\(\s*(?:\.{2,}+|…)\s*\)|(?<!\.)\.{2,}+|…)\s*\Z")
FINISHED = re.compile(r"[.!?。！？।॥؟۔][\"“”»」』)\]’'\s]*+\Z")
_CLOSING, _STOPS = "\"“”»」』)]’'", frozenset(".!?。！？।॥؟۔")
PIECE = re.compile(r"\d+(?:[.,x×]\d+)*|[぀-ヿ㐀-鿿฀-๿]|[^\W\d_]+(?:[̀-ͯऀ-ॣً-ٟ]+\w*)*|[^\w\s]")
HEADER_CUT = re.compile(r"the\s+region(?:\s+\d+(?:\s+is(?:\s+[a-z]+){0,4})?)?\s*\Z", re.I)
DENSE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")


_TAGS = re.compile(r"the\s+region\s+\d+\s+is\s+<region>\s*\d*\s*</region>\s*\.?|</?region>\s*\d*|<[a-z/]+>", re.I)


def content(text: str) -> str:
    """The text without region headers and tags."""
    if parts := hard(text):
        at, kept = 0, []
        for s, e in parts:
            kept.append(text[at:s])
            at = e
        text = " ".join([*kept, text[at:]])
    return _TAGS.sub(" ", text) if "<" in text else text


def _says(part: str) -> bool:
    part = _TAGS.sub(" ", part) if "<" in part else part
    words = (w.strip(".,;:!\"'") for w in part.lower().split())
    return any(w and w not in NOTHING and any(map(str.isalnum, w)) and not w.isdigit() for w in words)


def states_nothing(text: str) -> bool:
    """Is nothing left of the text without headers, tags and placeholders?"""
    at = 0
    for s, e in hard(text):
        if _says(text[at:s]):
            return False
        at = e
    return not _says(text[at:])


def omission(text: str) -> re.Match | None:
    """The mark of omission at the end of a stripped text."""
    if text[-1:] not in (".", "…", "]", ")") or (text[-1] == "." and text[-2:] != ".."):
        return None
    return OMISSION.search(text)


def stops(text: str) -> bool:
    """Does a stripped text end with a final stop that is no mark of omission?"""
    return final_stop(text) >= 0 and omission(text) is None


def final_stop(text: str) -> int:
    """Where the stop stands after which a text has closing marks and white space only, or -1."""
    while True:
        bare = text.rstrip().rstrip(_CLOSING)
        if len(bare) == len(text):
            return len(text) - 1 if text and text[-1] in _STOPS else -1
        text = bare


def tail(unit: str, k: int) -> list[str]:
    """The last ``k`` pieces of a unit, numbers as ``#``. Pieces hold no white space, so only as many
    words as it takes are looked at."""
    at = len(unit)
    while True:
        at = max(unit.rfind(" ", 0, max(at - 40, 0)), 0)
        got = PIECE.findall(unit[at:].lower())
        if at == 0 or len(got) >= k:
            return ["#" if p[0].isdigit() else p for p in got[-k:]]


def closings(unit: str) -> list[int]:
    """Hashes of the last words of a finished sentence, four and three pieces long."""
    return list(_closings(unit)) if len(unit) < 400 else _closing(unit)


@lru_cache(30_000)
def _closings(unit: str) -> tuple[int, ...]:
    return tuple(_closing(unit))


def _closing(unit: str) -> list[int]:
    if (at := final_stop(unit)) >= 0:
        unit = unit[:at]
    t = tail(unit, 4)
    if DENSE.search(unit[-3:] or " "):
        return [_hash("d", t)]
    return [_hash("w", t), _hash("v", t[-3:])]


def _hash(kind: str, pieces: Sequence[str]) -> int:
    x = xxhash.xxh3_64_intdigest(kind + "\0" + " ".join(pieces))
    return x - (1 << 64) if x >> 63 else x


class Judge:
    """What the end of one text says by itself."""

    def __init__(self, v: Verdicts):
        self.split = Splitter(v)

    def finished(self, text: str, spans: list[tuple[int, int]]) -> list[str]:
        out = []
        for n, (s, e) in enumerate(spans):
            u = text[s:e]
            if u[-1] == ":" and HARD.fullmatch(u):
                continue
            if final_stop(u) >= 0 and not omission(u) and self.open_mark(u) is None:
                out.append(u)
            elif n + 1 < len(spans) and DENSE.search(u[-1]):
                out.append(u)  # in Thai the blank before the next unit is the only sign
        return out

    @staticmethod
    def open_mark(unit: str) -> str | None:
        """A bracket or quotation mark that the unit does not close."""
        if unit.count("(") > unit.count(")") or unit.count("[") > unit.count("]"):
            return "bracket"
        if unit.count('"') % 2:
            return "quote"
        if unit.isascii():
            return None
        for o, c in CLOSERS.items():
            if o not in '"“' and o in unit and not any(x in unit[unit.rindex(o) :] for x in c):
                return "quote"
        if "“" in unit and "„" not in unit and "”" not in unit[unit.rindex("“") :]:
            return "quote"
        return None

    def verdict(self, text: str, spans: list[tuple[int, int]]) -> tuple[str, str, list[int]]:
        """``(state, rest, closings)``: state ``cut``, ``whole`` or ``open``; an open text is cut
        unless one of ``closings`` ends finished sentences of the corpus."""
        text = text.rstrip()
        m = omission(text)
        marked = m is not None
        bare = text[: m.start()].rstrip() if m else text
        if states_nothing(bare):
            return "whole", bare, []
        if marked:
            spans = self.split.spans(bare)
        last = bare[spans[-1][0] : spans[-1][1]] if spans else ""
        if HARD.fullmatch(last):
            return "cut", bare, []
        end = final_stop(bare)
        if end >= 0 and (not marked or bare[-1] != "."):
            at = end
            while at > 0 and not bare[at - 1].isspace() and bare[at - 1] not in "([\"“„«":
                at -= 1
            word = bare[at:end]
            if self.open_mark(last):
                return "cut", bare, []
            if bare[end] == "." and word and word[-1].isalpha() and self.split._is_abbreviation(bare, word):
                return "cut", bare, []
            if bare[end:].strip() == "." and word.isdigit():
                return "open", bare, closings(last)
            return "whole", bare, []
        if end >= 0 and self.open_mark(last) is None:
            return "whole", bare, []
        if self.open_mark(last) or HEADER_CUT.search(last):
            return "cut", bare, []
        if marked:
            return "cut", bare, []
        return "open", bare, closings(last)


def _texts(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(f).alias("field"), df[f].cast("string").alias("text")) for f in fields))
    return df.select(df[key].cast("long").alias("id"), F.explode(cells).alias("c")).select("id", "c.field", "c.text").filter(r"text rlike '\\S'")


def most_edits(n: int) -> int:
    """Words in which copies of an opening of ``n`` words may differ, one more for the shift."""
    return int(SHARE * n) + 1


#: the successions from which and up to which those of each opening lie, by number of the opening
_REACH = np.array([(max(n - most_edits(n), 1) - 1, 2 * n - 1 + most_edits(2 * n - 1)) for n in (HEAD << i for i in range(40))])


def _filed(ws: list[str], sketch: nc.Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys of the openings, one row for each; for each opening a bit for every succession of
    words with which a text that asks for it may end; and all successions as 16 bits."""
    h = nc.hashes(ws)
    bands, codes = sketch.openings_of(h, HEAD), nc.successions(ws, h)
    bits = np.uint64(1) << (codes & 63).astype(np.uint64)
    marks = np.zeros(len(bands), np.uint64)
    if len(bands):
        # from and to of each opening; only the unions of every other part count
        at = np.minimum(_REACH[: len(bands)].ravel(), len(bits))
        marks = np.bitwise_or.reduceat(np.append(bits, np.uint64(0)), at)[::2]
    return bands, marks.view(np.int64), (codes >> 6).astype(np.int16)


#: words of the texts that are filed at once, and of the longest text among them
AT_ONCE = 2048


def _all_filed(texts: list[list[str]], sketch: nc.Sketch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_filed`` for every text, short ones together, which takes a fraction of the calls."""
    out: list = [None] * len(texts)
    group: list[int] = []
    n = 0
    for i, ws in enumerate(texts):
        if not HEAD <= len(ws) <= AT_ONCE:
            out[i] = _filed(ws, sketch)
            continue
        if n + len(ws) > AT_ONCE and group:
            _file(group, texts, sketch, out)
            group, n = [], 0
        group.append(i)
        n += len(ws)
    if group:
        _file(group, texts, sketch, out)
    return out


def _file(group: list[int], texts: list[list[str]], sketch: nc.Sketch, out: list) -> None:
    ws = list(chain.from_iterable(texts[i] for i in group))
    sizes = np.array([len(texts[i]) for i in group])
    h, last = nc.hashes(ws), np.cumsum(sizes)
    bands = sketch.openings_of_all(h, sizes, HEAD)
    codes = np.append(nc.successions(ws, h), np.int32(0))
    bits = np.uint64(1) << (codes & 63).astype(np.uint64)
    bits[last - 1] = 0  # no word follows the last one of a text
    many = [nc.openings_in(n, HEAD) for n in sizes.tolist()]
    starts = (last - sizes).tolist()
    at = np.concatenate([s + np.minimum(_REACH[:m].ravel(), n - 1) for s, m, n in zip(starts, many, sizes.tolist())])
    marks = np.bitwise_or.reduceat(bits, at)[::2].view(np.int64)
    codes = (codes >> 6).astype(np.int16)
    k = 0
    for i, s, m, n in zip(group, starts, many, sizes.tolist()):
        out[i] = bands[k : k + m], marks[k : k + m], codes[s : s + n - 1]
        k += m


COLUMNS = "id long, field string, state string, close array<long>, cls long, n int, bands array<long>, marks array<long>, codes array<short>, asked array<long>, bit long, code short, ends array<long>, counts array<int>"


def _described(texts: Sequence[str], judge: Judge, sketch: nc.Sketch) -> list[tuple]:
    """The values of ``COLUMNS`` from ``state`` on for each text."""
    all_words, out = [], []
    for text in texts:
        spans = judge.split.spans(text)
        state, bare, close = judge.verdict(text, spans)
        all_words.append(ws := nc.words(bare))
        ends = Counter(h for u in judge.finished(text, spans) for h in closings(u))
        out.append((state, close, nc.fingerprint(ws if len(bare) == len(text) else nc.words(text)), ends))
    filed = _all_filed(all_words, sketch)
    for k, (ws, (state, close, cls, ends), (bands, marks, codes)) in enumerate(zip(all_words, out, filed)):
        asked, bit, code = [], 0, 0
        if len(ws) > HEAD:
            last = nc.successions(ws[-2:])
            bit, code = int(last[0] & 63), int((last >> 6).astype(np.int16)[0])
            if state != "whole":
                # the last word may be cut, so it is not looked up
                asked = bands[len(bands) - 1 - (HEAD << len(bands) - 1 == len(ws))]
        out[k] = state, close, cls, len(ws), bands.ravel(), marks, codes, asked, bit, code, list(ends), list(ends.values())
    return out


def _judged(texts: DataFrame, v: Verdicts, dealt: bool = False) -> DataFrame:
    """Texts with their state, class, keys and closings, as a table. ``dealt``: they lie in enough
    partitions already."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, sketch = Judge(v), nc.Sketch(BANDS, ROWS, SHINGLE)
        for b in batches:
            seen: dict[str, tuple] = {}
            for part in batched(dict.fromkeys(b["text"]), 128):  # the words of few texts are held at once
                seen |= zip(part, _described(part, judge, sketch))
            rows = [(i, f, *seen[text]) for i, f, text in zip(b["id"], b["field"], b["text"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return cut((texts if dealt else spread(texts)).mapInPandas(each, COLUMNS), "judged")


def _classes(table: DataFrame, real: Column | bool = True) -> DataFrame:
    """One row for each sequence of words: its first row, keys and closings, and whether it occurs in
    real rows. As a table."""
    first = ("n", "bands", "marks", "codes", "bit", "code", "ends", "counts")
    real = F.lit(real) if isinstance(real, bool) else real
    return cut(
        table.groupBy("cls").agg(F.min(F.struct("id", "field")).alias("rep"), F.max(real).alias("real"), *(F.first(c).alias(c) for c in first), F.max("asked").alias("asked")), "classes"
    )


#: how an aligned pair ends
LONGER, END, CUT = "longer", "end", "cut"


@lru_cache(2_000)
def _bare(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A text without its mark of omission, and its words with their places."""
    text = text.rstrip()
    m = OMISSION.search(text)
    text = text[: m.start()].rstrip() if m else text
    return text, list(nc.spots(text))


def align(short: str, full: str, abbreviation: dict[str, bool]) -> str | None:
    """How ``short`` ends against ``full``: ``cut`` inside a word or sentence of ``full``, ``end``
    at the end of one of its sentences, or None if the two are no copies."""
    bare, spots = _bare(short)
    # no later word of the other copy is looked at
    whole = list(islice(nc.spots(full), len(spots) + most_edits(len(spots)) + 2))
    a, b = [x[0].lower() for x in spots], [x[0].lower() for x in whole]
    if len(a) <= HEAD or len(b) < len(a):
        return None
    # the last word may be cut, so all but it must agree with the opening of the other copy
    head = a[:-1]
    most = most_edits(len(head))
    fit = None
    for shift in sorted(range(-most, most + 1), key=abs):
        k = len(head) + shift
        if 0 < k < len(b) and b[k].startswith(a[-1]) and (k == 0 or b[k - 1] == head[-1]):
            if nc.edits(head, b[:k], most) is not None:
                fit = k
                break
    if fit is None:
        return None
    if len(a[-1]) < len(b[fit]):
        return CUT
    if fit + 1 >= len(b):
        return END  # nothing but marks follows
    between = full[whole[fit][2] : whole[fit + 1][1]]
    after = bare[spots[-1][2] :]
    if FINISHED.search(after) or HARD.match(full, whole[fit + 1][1]):
        return END
    if between == "." and not full[whole[fit + 1][1]].isupper() or between.startswith(".") and (len(a[-1]) == 1 and a[-1].isalpha() or abbreviation.get(a[-1])):
        return CUT  # a decimal point or an abbreviation
    return END if re.search(r"[.!?。！？।؟۔]", between) else CUT


def _aligner(v: Verdicts):
    known = {w: True for w, is_one in v.abbreviation.items() if is_one}

    @F.pandas_udf(StringType())
    def aligned(short: pd.Series, full: pd.Series) -> pd.Series:
        return pd.Series([align(x, y, known) for x, y in zip(short, full)], dtype="object")

    return aligned


def _pairs(classes: DataFrame) -> DataFrame:
    """Each unfinished class with every class of its opening that is as long or longer and goes on in
    the same way where it ends: ``cls_s, rep_s, rep_f``."""
    short = classes.filter("size(asked) > 0").select(F.explode("asked").alias("key"), F.col("cls").alias("cls_s"), F.col("n").alias("n_s"), "bit", "code")
    # texts of one opening may go on differently, so none of them stands for the others
    full = (
        classes.filter("real and size(bands) > 0")
        .select("cls", "n", "marks", F.posexplode("bands").alias("p", "key"))
        .select("key", F.col("cls").alias("cls_f"), F.col("n").alias("n_f"), F.expr(f"marks[cast(p div {BANDS} as int)]").alias("marks"))
    )
    marked = F.expr("(shiftright(marks, cast(bit as int)) & 1L) = 1")
    pairs = short.join(full, "key").filter(marked & F.expr("n_f >= n_s and cls_f <> cls_s")).select("cls_s", "cls_f", "n_s", "code").distinct()
    most = F.expr(f"cast({SHARE} * (n_s - 1) as int) + 1")
    start = F.greatest(F.col("n_s") - 1 - most, F.lit(1))
    near = F.slice("codes", start, F.col("n_s") + most - start)
    pairs = pairs.join(classes.select(F.col("cls").alias("cls_f"), F.col("rep").alias("rep_f"), "codes"), "cls_f").filter(F.array_contains(near, F.col("code")))
    return pairs.select("cls_s", "rep_f").join(classes.select(F.col("cls").alias("cls_s"), F.col("rep").alias("rep_s")), "cls_s")


def examined(df: DataFrame, key: str, fields: Sequence[str], v: Verdicts | None = None, real: Column | bool = True, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every class of texts that are not blank, with its closings (a table), and ``id, field, cls,
    truncated`` of each text with the evidence as votes (1 cut, 0 whole, -1 silent): by its marks,
    closing words, and copies. Rows for which ``real`` (on ``id``) is false are judged by the others."""
    texts = _texts(df, key, fields)
    v = v or verdicts(texts.select("text"))
    table = _judged(texts, v, dealt)
    classes = _classes(table, real)
    ends = classes.filter("real").select(F.explode(F.arrays_zip("ends", "counts")).alias("z")).groupBy(F.col("z.ends").alias("h")).agg(F.sum("z.counts").alias("seen"))
    least = max(SEEN, RATE * classes.filter("real").count())
    seen = (
        table.filter("state = 'open'")
        .select("cls", F.posexplode("close").alias("p", "h"))
        .distinct()
        .join(ends, "h")
        .groupBy("cls")
        .agg(F.bool_or(F.col("seen") >= F.when(F.col("p") == 0, F.lit(least)).otherwise(F.lit(3 * least))).alias("closes"))
    )
    pairs = cut(_pairs(classes), "openings")
    wanted = pairs.select("rep_s").union(pairs.select("rep_f")).distinct().select(F.col("rep_s.id").alias("id"), F.col("rep_s.field").alias("field"))
    got = texts.join(wanted, ["id", "field"], "left_semi").dropDuplicates(["id", "field"]).select(F.struct("id", "field").alias("rep"), "text")
    both = pairs
    for side, name in (("s", "short"), ("f", "full")):
        both = both.join(got.select(F.col("rep").alias(f"rep_{side}"), F.col("text").alias(name)), f"rep_{side}")
    ended = both.select("cls_s", _aligner(v)("short", "full").alias("how")).filter("how is not null")
    ended = ended.groupBy(F.col("cls_s").alias("cls")).agg(F.bool_or(F.col("how") == CUT).alias("cut"))
    out = table.select("id", "field", "state", "cls").join(seen, "cls", "left").join(ended, "cls", "left")
    alone = (F.col("state") == "open") & ~F.coalesce("closes", F.lit(False))
    verdict = F.when(F.col("state") == "cut", True).otherwise(F.coalesce("cut", alone))
    own = F.when(F.col("state") == "open", -1).otherwise((F.col("state") == "cut").cast("int"))
    close = F.when(F.col("state") == "open", alone.cast("int")).otherwise(-1)
    copy = F.coalesce(F.col("cut").cast("int"), F.lit(-1))
    return classes, out.select("id", "field", "cls", verdict.alias("truncated"), own.alias("by_marks"), close.alias("by_words"), copy.alias("by_copy"))


def states(df: DataFrame, key: str, fields: Sequence[str], v: Verdicts | None = None) -> DataFrame:
    """``id, field, truncated`` for every text of ``fields`` that is not blank."""
    return examined(df, key, fields, v)[1].select("id", "field", "truncated")


def truncated(df: DataFrame, key: str = "sample_id", fields: Sequence[str] = ("Pred_combined_report", "GT_combined_report")) -> DataFrame:
    return states(df, key, fields).filter("truncated").select(F.col("id").alias(key), "field")


def rates(df: DataFrame, key: str, fields: Sequence[str], source: str) -> DataFrame:
    """``<source>, field, n, n_truncated``: how often each source truncates."""
    s = states(df, key, fields)
    by = df.select(F.col(key).cast("long").alias("id"), source)
    return s.join(by, "id").groupBy(source, "field").agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("n_truncated"))
