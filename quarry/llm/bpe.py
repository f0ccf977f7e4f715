"""Byte-pair encoding of a corpus with a public vocabulary, by backtracking.

A pre-token is encoded without simulating merges. An Aho-Corasick automaton over all tokens gives,
in one scan, the longest token at every byte; the encoder takes it, checks against the token before
whether the two can stand side by side in a correct encoding, and falls back to the next shorter
token, or steps back, where they cannot. Positions found to lead nowhere are marked, so the work is
linear in the length. Two tokens are compatible if no merge across their border would have been
made before both were complete; verdicts are kept in a table.

The vocabulary (a fixed file below 1 MB) is read on the driver and sent to the executors once.

Defined results
    * null and empty text: an empty list; blank text is encoded like any other
    * special tokens are never produced: their strings are ordinary text
    * one row for each input row, repeated rows included; other columns are ignored
    * texts of any length are encoded whole
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from quarry.plans.spread import spread

#: the public pre-tokenization pattern of byte-level BPE (fixed value)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Exact BPE encoder of pre-tokens for ranks in which every merge outranks its parts."""

    #: pre-tokens up to this many bytes are remembered
    SHORT = 48
    #: entries after which what is remembered is forgotten
    KEEP = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.text = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.known: dict[str, list[int]] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            for n in range(len(b) - 1, 0, -1):
                if (j := ranks.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
            for n in range(1, len(b)):
                l, r = ranks.get(b[:n]), ranks.get(b[n:])
                if l is not None and r is not None and max(l, r) < i and self.fits(l, r):
                    self.parts[i] = l, r
                    self.made[l, r] = i
                    self.compatible.pop((l, r), None)
                    break
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()

    def fits(self, left: int, right: int) -> bool:
        """Do ``left`` and ``right`` keep apart when their joined bytes are encoded?

        Undo the merges of both sides from the latest to the earliest. At every moment the two
        parts at the border could be merged only if that merge comes before the ones undone so far.
        """
        key = left, right
        known = self.compatible.get(key)
        if known is not None:
            return known
        l, r, bound = left, right, 1 << 60
        ok = True
        while True:
            made = self.made.get((l, r))
            if made is not None and made < bound:
                ok = False
                break
            lp, rp = self.parts.get(l), self.parts.get(r)
            if lp is None and rp is None:
                break
            # of two merges the later one is undone first; on the right side a merge of the same
            # rank comes later, as merges of one rank go from left to right
            if rp is None or (lp is not None and l > r):
                bound, l = l, lp[1]
            else:
                bound, r = r + 1, rp[0]
        self.compatible[key] = ok
        return ok

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        size = self.length
        for last, i in self.automaton.iter(piece.decode("latin-1")):
            at = last + 1 - size[i]
            if longest[at] < 0 or size[i] > size[longest[at]]:
                longest[at] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        shorter, fits = self.shorter, self.fits
        while True:
            then = at + size[token]
            if not dead[then] and (not out or fits(out[-1], token)):
                out.append(token)
                at = then
                if at == n:
                    return out
                token = longest[at]
            elif token in shorter:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                # the token that led here is tried again, now with its end marked

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in self.split(text):
            got = known.get(p)
            if got is None:
                b = p.encode("utf-8", "surrogatepass")
                got = self.piece(b)
                if len(b) <= self.SHORT:
                    if len(known) >= self.KEEP:
                        known.clear()
                    known[p] = got
            out += got
        return out


class Decoder:
    """Decoding by an offset table: token ``i`` is ``blob[offset[i]:offset[i + 1]]``."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            tokens[i] = b
        self.offset = [0, *accumulate(map(len, tokens))]
        self.blob = b"".join(tokens)

    def decode(self, ids) -> str:
        o, blob = self.offset, self.blob
        return b"".join(blob[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


_sent: dict = {}


def _shared(broadcast, kind):
    """One encoder or decoder for each worker process and vocabulary."""
    key = kind, id(broadcast.value)
    if key not in _sent:
        _sent[key] = broadcast.value, kind(broadcast.value)
    return _sent[key][1]


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``<id_col>, ids``: the token ids of every text."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _shared(sent, Encoder)
        for b in batches:
            yield pd.DataFrame({id_col: b.iloc[:, 0], "ids": [encoder.encode(t) if t else [] for t in b.iloc[:, 1]]})

    cols = df.select(df[id_col].cast("long").alias(id_col), df[text_col].cast("string").alias("text"))
    return spread(cols).mapInPandas(each, f"`{id_col}` long, ids array<int>")


def decode(df: DataFrame, id_col: str, vocabulary: str = VOCABULARY, ids_col: str = "ids") -> DataFrame:
    """``<id_col>, text``: the texts of id lists; null ids give null."""
    sent = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _shared(sent, Decoder)
        for b in batches:
            yield pd.DataFrame({id_col: b.iloc[:, 0], "text": [None if x is None else decoder.decode(x) for x in b.iloc[:, 1]]})

    cols = df.select(df[id_col].cast("long").alias(id_col), df[ids_col].cast("array<int>").alias("ids"))
    return cols.mapInPandas(each, f"`{id_col}` long, text string")
