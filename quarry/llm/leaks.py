"""Passages of held-out items inside a corpus, by a stored positional inverted index.

``Index`` writes the postings of the corpus once, as segments: each holds, for the documents of one
batch, every term with the documents and positions at which it stands. A term's list is thus spread
over all segments, however frequent it is, and nothing is shuffled to build them. A search reads the
lists of the terms it needs only: of every window of ``RUN`` words of an item the rarest terms,
whose lists, shifted by the position in the item, are intersected segment by segment. The documents
that survive are read and compared word by word. Any number of item sets can be searched with one
index.

Items are cut into overlapping pieces of at most ``PIECE`` words and searched in blocks of at most
``BLOCK`` words, so what is sent to the executors is bounded for any number and length of items.

Defined results
    * null and empty texts, and items shorter than a run, match nothing
    * repeated documents come out once for every ``doc_id``; repeated items likewise
    * a passage may start and end anywhere; documents of any length are indexed whole
    * extra columns are ignored
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.durable import cut, sized
from quarry.plans.spread import spread

#: consecutive words that make a leak
RUN = 12
#: terms of a window whose postings are intersected, beyond those that may be missing
ANCHORS = 3
#: words of the largest piece of an item, and of the items that are searched at once
PIECE, BLOCK = 5_000, 100_000
#: words of a segment from which on it is closed
SEGMENT = 4_000_000
#: most document ids that are sent to all executors
SENT = 200_000

_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    """Words without case, accents and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if c < "\x7f" or unicodedata.category(c) not in ("Mn", "Cf"))
    return _WORD.findall(text.casefold())


def _segment(ids: list[int], words: list[list[str]], number: int) -> pa.RecordBatch:
    """The postings of some documents, by term."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    terms = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
    rank = pc.sort_indices(terms.dictionary)  # sorted terms let a reader skip what it does not need
    place = np.empty(len(rank), np.int64)
    place[rank.to_numpy()] = np.arange(len(rank))
    at = place[terms.indices.to_numpy(zero_copy_only=False)]
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=len(rank))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    docs = np.repeat(np.array(ids, np.int64), sizes)[order]
    pos = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rank), number), pa.int64()), terms.dictionary.take(rank), pa.array(counts, pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(docs)), pa.ListArray.from_arrays(offsets, pa.array(pos, pa.int32())),
        ],
        names=["seg", "term", "n", "docs", "pos"],
    )


class Index:
    """The postings of a corpus, stored once, and the corpus itself."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).filter("text is not null")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            for b in batches:
                ids, words, n = [], [], 0
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    w = normal_words(t)
                    if w and i is not None:
                        ids.append(i)
                        words.append(w)
                        n += len(w)
                    if n >= SEGMENT:
                        yield _segment(ids, words, number)
                        ids, words, n, number = [], [], 0, number + 1
                if ids:
                    yield _segment(ids, words, number)
                    number += 1

        self.postings = cut(spread(self.docs).mapInArrow(each, "seg long, term string, n long, docs array<long>, pos array<int>"), "postings")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Uses of the terms of one block in the corpus."""
        if not terms:
            return {}
        asked = self.postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        found = self.postings.select("term", "n").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n"))
        return {r.term: r.n for r in found.collect()}

    def texts(self, ids: DataFrame) -> DataFrame:
        """``doc_id, text`` of the documents in ``ids``. They go to the corpus where they are few (their
        number is counted); the corpus is shuffled only if they are many."""
        return self.docs.join(sized(ids.select("doc_id").distinct(), "near", SENT), "doc_id", "left_semi")


def _pieces(items: DataFrame) -> DataFrame:
    """``item_id, words``: the items in pieces such that each run of an item is in one of them."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item_id"], b["text"]):
                w = normal_words(t)
                rows += [(i, w[k : k + PIECE]) for k in range(0, max(len(w) - RUN + 1, 0), PIECE - RUN + 1)]
            yield pd.DataFrame(rows, columns=["item_id", "words"])

    cols = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).filter("text is not null and item_id is not null")
    return cut(spread(cols).mapInPandas(each, "item_id long, words array<string>"), "items")


class Plan:
    """What a search of one block looks up: for each piece its sets of anchors with the windows that
    have them, and for each piece and anchor the term."""

    def __init__(self, pieces: list[list[str]], df: dict[str, int], missing: int):
        self.sets: list[dict[tuple[int, ...], list[int]]] = []
        self.pieces, self.missing = pieces, missing
        self.terms: set[str] = set()
        for words in pieces:
            rare = [(df.get(w, 0), i) for i, w in enumerate(words)]
            sets: dict[tuple[int, ...], list[int]] = {}
            for s in range(len(words) - RUN + 1):
                window = sorted(rare[s : s + RUN])
                if window[missing][0]:  # otherwise more words than may be missing stand nowhere
                    sets.setdefault(tuple(sorted(i for _, i in window[: ANCHORS + missing])), []).append(s)
            self.sets.append(sets)
            self.terms.update(words[i] for s in sets for i in s)

    def matches(self, lists: dict[str, tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[int]]]:
        """``documents, places, piece, windows``: the anchors of these windows, but for those that may
        be missing, stand in the documents at shifts of the same place. A place covers one shift
        (``width`` 1), or ``2 * width`` shifts and starts every ``width``."""
        for number, (words, sets) in enumerate(zip(self.pieces, self.sets)):
            keys: dict[int, np.ndarray] = {}
            for anchors, starts in sets.items():
                got = []
                for i in anchors:
                    if i not in keys:
                        docs, pos = lists.get(words[i], _NONE)
                        off = (pos - i) // width
                        # positions and shifts fit into 32 bits
                        k = (docs << 33) + (off + _ZERO)
                        keys[i] = k if width == 1 else np.unique(np.concatenate([k, k + 1]))
                    got.append(keys[i])
                if sum(map(len, got)) == 0:
                    continue
                k, n = np.unique(np.concatenate(got), return_counts=True)
                k = k[n >= ANCHORS]
                if len(k):
                    yield k >> 33, (k & ((1 << 33) - 1)) - _ZERO, number, starts


_ZERO = 1 << 31
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _matcher(plan: Plan, width: int):
    def matched(segment: pd.DataFrame) -> pd.DataFrame:
        # documents by their number in the segment, so that keys fit into 64 bits
        ids, numbers = np.unique(np.concatenate(segment["docs"].to_list()), return_inverse=True)
        ends = np.cumsum(segment["docs"].map(len).to_numpy())
        lists = {t: (numbers[e - len(p) : e], np.asarray(p, np.int64)) for t, p, e in zip(segment["term"], segment["pos"], ends)}
        got = [(i, p, number, starts) for docs, places, number, starts in plan.matches(lists, width) for i, p in zip(ids[docs].tolist(), places.tolist())]
        return pd.DataFrame(got, columns=["doc_id", "place", "piece", "starts"])

    return matched


Check = Callable[[list[str], list[str], int, list[int]], bool]


def _checker(pieces: list[tuple[int, list[str]]], check: Check):
    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, places in zip(b["doc_id"], b["text"], b["places"]):
                words, held = normal_words(text), set()
                for p in places:
                    item, piece = pieces[p["piece"]]
                    if item not in held and check(words, piece, p["place"], p["starts"]):
                        held.add(item)
                rows += [(doc, item) for item in held]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    return checked


def _search(index: Index, items: DataFrame, missing: int, width: int, check: Check) -> DataFrame:
    """``doc_id, item_id`` of all pairs with a window whose anchors meet and whose words, piece, place
    and windows pass ``check``."""
    spark = items.sparkSession
    pieces = _pieces(items)
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // BLOCK)
    out = spark.createDataFrame([], "doc_id long, item_id long")
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(blocks, 1))))
    for block in range(blocks):  # a block is bounded; their number grows with the items
        rows = [(r.item_id, r.words) for r in numbered.filter(F.col("block") == block).collect()]
        words = [w for _, w in rows]
        plan = Plan(words, index.frequencies(list(set(chain.from_iterable(words)))), missing)
        if not plan.terms:
            continue
        asked = spark.createDataFrame([(t,) for t in plan.terms], "term string")
        lists = index.postings.join(F.broadcast(asked), "term", "left_semi").groupBy("seg")
        near = cut(lists.applyInPandas(_matcher(plan, width), "doc_id long, place long, piece int, starts array<int>"), "hits")
        places = near.groupBy("doc_id").agg(F.collect_list(F.struct("piece", "place", "starts")).alias("places"))
        both = places.join(index.texts(near), "doc_id").select("doc_id", "text", "places")
        out = out.unionByName(both.mapInPandas(_checker(rows, check), "doc_id long, item_id long"))
    return out.distinct()


def passages(docs: DataFrame, items: DataFrame, index: Index | None = None) -> DataFrame:
    """``doc_id, item_id``: the document holds ``RUN`` consecutive words of the item."""

    def check(words: list[str], piece: list[str], place: int, starts: list[int]) -> bool:
        return any(place + s >= 0 and words[place + s : place + s + RUN] == piece[s : s + RUN] for s in starts)

    return _search(index or Index(docs), items, 0, 1, check)


def proximity(docs: DataFrame, items: DataFrame, index: Index | None = None, slack: int = 3, near: int = 10) -> DataFrame:
    """``doc_id, item_id``: of some window of ``RUN`` words at least ``near`` stand in the document at
    shifts of one place, which covers ``2 * slack`` shifts, so that a few changed, inserted or lost
    words do not hide a passage, whichever they are."""

    def check(words: list[str], piece: list[str], place: int, starts: list[int]) -> bool:
        low = (place - 1) * slack  # the first shift of the place
        here = [piece[k] in words[max(low + k, 0) : max(low + k + 2 * slack, 0)] for k in range(min(starts), max(starts) + RUN)]
        return any(sum(here[s - min(starts) : s - min(starts) + RUN]) >= near for s in starts)

    return _search(index or Index(docs), items, RUN - near, slack, check)


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, split, n_docs`` for every item, 0 where nothing leaked."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "split").join(n, "item_id", "left").select("item_id", "split", F.coalesce("n", F.lit(0)).alias("n_docs"))
