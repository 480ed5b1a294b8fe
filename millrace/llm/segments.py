"""Cutting oversized passages at natural boundaries, by lexical cohesion.

The words of a passage before and after each candidate boundary are compared in sliding blocks; where
their similarity forms a valley the topic changes. Within the window of ends that the size limit
allows, the boundary of the deepest valley is taken; the next piece starts a given overlap before it.
Sizes are token estimates. A narrow map: passages are not shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import CHARS_PER_TOKEN, DENSE_LOSS, DENSE_SCRIPTS, estimate_tokens
from millrace.llm.sentences import sentence_units

LIMIT, OVERLAP = 220, 32
#: Words in each of the two blocks that are compared.
BLOCK = 40
#: The first end that a piece may have, as a share of the limit.
EARLIEST = 0.45
# Languages without spaces between words, where any character may begin a piece.
UNSPACED = ("zho_Hans", "jpn_Jpan", "tha_Thai")

_DENSE = regex.compile("[" + "".join(rf"\p{{{s}}}" for s in DENSE_SCRIPTS) + "]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_INSIDE = regex.compile(r"(?<=[\p{L}\p{M}\p{N}])(?=[\p{L}\p{M}\p{N}])")
_SPACE = regex.compile(r"\s+")
_CLAUSE = regex.compile(r"[,;:，、；：،؛—–)\]）」』”]\s*")
_COMBINING = regex.compile(r"\p{M}")


class _Passage:
    """A passage with what its cuts are chosen by."""

    def __init__(self, text: str, language: str | None):
        self.text, self.language = text, language
        self.dense = np.zeros(len(text) + 1, dtype="i8")
        marks = [m.start() for m in _DENSE.finditer(text)]
        self.dense[1:][marks] = 1
        np.cumsum(self.dense, out=self.dense)
        self.unspaced = language in UNSPACED
        self.forbidden = bytearray(len(text) + 1)  # 1 where no cut may be
        # of unspaced scripts only a combining mark may not be cut off
        for m in (_COMBINING if self.unspaced else _INSIDE).finditer(text):
            self.forbidden[m.start()] = 1
        units = sentence_units(text, language)
        self.sentences = sorted({e for _, e in units if self.legal(e)} - {len(text)})
        self.starts = sorted({s for s, _ in units if self.legal(s)})
        self.clauses = sorted({m.end() for m in _CLAUSE.finditer(text) if self.legal(m.end())} - {0, len(text)})
        self.spaces = sorted({m.start() for m in _SPACE.finditer(text)} - {0, len(text)})
        self._words()

    def legal(self, at: int) -> bool:
        return not self.forbidden[at]

    def estimate(self, a: int, b: int) -> int:
        n = b - a
        if n <= 0:
            return 0
        return max(1, math.ceil(n / (CHARS_PER_TOKEN - DENSE_LOSS * int(self.dense[b] - self.dense[a]) / n)))

    def furthest(self, a: int, limit: int) -> int:
        """The last end of a piece from ``a`` that is within the limit. Estimates grow with the length."""
        low, high = a, min(len(self.text), a + int(limit * CHARS_PER_TOKEN))
        while low < high:
            mid = (low + high + 1) // 2
            if self.estimate(a, mid) <= limit:
                low = mid
            else:
                high = mid - 1
        return low

    def _words(self) -> None:
        words = [(m.start(), m.group().lower()) for m in _WORD.finditer(self.text)]
        if self.unspaced:  # pairs of characters stand for words
            words = [(at + i, w[i : i + 2]) for at, w in words for i in range(max(1, len(w) - 1))]
        self.at, self.words = [a for a, _ in words], [w for _, w in words]

    def _similarity(self, at: int) -> float:
        k = bisect_left(self.at, at)
        a, b = Counter(self.words[max(0, k - BLOCK) : k]), Counter(self.words[k : k + BLOCK])
        if not a or not b:
            return 0.0
        dot = sum(n * b[w] for w, n in a.items() if w in b)
        return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))

    def depths(self, candidates: list[int]) -> list[float]:
        """How deep the valley at each candidate is, below the peaks on either side of it."""
        s = [self._similarity(c) for c in candidates]

        def peaks(values: list[float]) -> list[float]:
            """Of each place the height that is reached going back uphill from it."""
            out: list[float] = []
            for i, v in enumerate(values):
                out.append(out[-1] if i and values[i - 1] >= v else v)
            return out

        left, right = peaks(s), peaks(s[::-1])[::-1]
        return [a - v + b - v for a, v, b in zip(left, s, right)]


def cut_passage(text: str, language: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(char_start, char_end, token_count) of the pieces; one if the passage is within the limit, none if it is empty.

    A run of letters longer than the limit has no natural boundary and is cut where the limit falls.
    """
    if not text:
        return []
    p = _Passage(text, language)
    end = len(text)
    if p.estimate(0, end) <= limit:
        return [(0, end, p.estimate(0, end))]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    depth = dict(zip(p.sentences, p.depths(p.sentences)))
    out, start = [], 0
    while True:
        last = p.furthest(start, limit)
        if last >= end:
            out.append((start, end, p.estimate(start, end)))
            return out
        done = out[-1][1] if out else 0
        first = max(done + 1, p.furthest(start, int(limit * EARLIEST)))
        at = _best(p.sentences, first, last, depth.get)
        if at is None:
            at = _best(p.clauses, first, last, float) or _best(p.spaces, max(start, done) + 1, last, float)
        if at is None:
            at = last
            while at > done + 1 and not p.legal(at):
                at -= 1
            if not p.legal(at) or at <= start:
                at = last  # no boundary at all
        out.append((start, at, p.estimate(start, at)))
        start = _overlapped(p, start, at, limit, overlap)


def _best(points: list[int], first: int, last: int, value) -> int | None:
    """The point of first..last of the greatest value, the later of equal ones."""
    inside = points[bisect_left(points, first) : bisect_right(points, last)]
    return max(inside, key=lambda x: (value(x), x)) if inside else None


def _overlapped(p: _Passage, start: int, at: int, limit: int, overlap: int) -> int:
    """Where the next piece starts: a unit or word within the overlap before ``at``, else the nearest legal place before it."""
    earliest = at
    while earliest > start + 1 and p.estimate(earliest - 1, at) <= overlap:
        earliest -= 1
    for points in (p.starts, [s + 1 for s in p.spaces if p.legal(s + 1)]):
        inside = points[bisect_left(points, earliest) : bisect_left(points, at)]
        if inside:
            return inside[0]
    back = at - 1
    while back > start + 1 and not p.legal(back):
        back -= 1
    if back <= start + 1 or p.estimate(back, at) > limit // 2:
        back = max(earliest, start + 1) if overlap else at
    return back


_PIECES = "array<struct<piece:int,char_start:int,char_end:int,token_count:int>>"


def _pieces_udf(limit: int, overlap: int):
    @F.pandas_udf(_PIECES)
    def pieces_of(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"piece": i, "char_start": a, "char_end": b, "token_count": n} for i, (a, b, n) in enumerate(cut_passage(t or "", g, limit, overlap))] for t, g in zip(texts, languages)],
            dtype=object,
        )

    return pieces_of


def split_oversized(df: DataFrame, key: str, text: str = "text", language: str = "language", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, piece (from 0), char_start, char_end, token_count of each passage above ``limit`` tokens.

    Passages within the limit, null and empty ones have no rows. Each piece is within the limit and
    starts before the end of the one before it. Repeated rows give repeated pieces.
    """
    large = df.filter(estimate_tokens(F.col(text)) > limit)
    return large.select(key, F.explode(_pieces_udf(limit, overlap)(F.col(text), F.col(language))).alias("p")).select(key, "p.*")


def _inside_word(text: Column, at: Column) -> Column:
    """Whether a cut before character ``at`` (from 0) has a letter, digit or mark on both sides."""
    return F.coalesce(F.substring(text, at, F.lit(2)).rlike(r"^[\p{L}\p{M}\p{N}]{2}"), F.lit(False))


def broken_pieces(pieces: DataFrame, passages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``pieces`` that break the cutting rules, with faults (array of names) and passage (its text).

    pieces: id, document_id, language, chunk_index, text, char_start, char_end, an id once. passages:
    document_id, text, a document once. Faults: oversized, offsets (not within the passage, or
    not those of the text; missing offsets or passage), inside_word, no_overlap (the piece before
    ends where this starts or earlier).
    """
    own = pieces.select("id", "document_id", "language", "chunk_index", "text", "char_start", "char_end")
    # the end of the piece before, without a join: pieces of one document lie together
    ends = own.filter("chunk_index IS NOT NULL").groupBy("document_id", (F.col("chunk_index") + 1).alias("chunk_index")).agg(F.max("char_end").alias("before_end"))
    rows = own.join(ends, ["document_id", "chunk_index"], "left").join(passages.select("document_id", F.col("text").alias("passage")), "document_id", "left")
    start, stop, passage = F.col("char_start"), F.col("char_end"), F.col("passage")
    exact = (start >= 0) & (start < stop) & (stop <= F.length(passage)) & (F.substring(passage, start + 1, stop - start) == F.col("text"))
    spaced = ~F.coalesce(F.col("language").isin(*UNSPACED), F.lit(False))
    cuts = ((start > 0) & _inside_word(passage, start)) | ((stop < F.length(passage)) & _inside_word(passage, stop))
    faults = {
        "oversized": estimate_tokens(F.col("text")) > limit,
        "offsets": ~F.coalesce(exact, F.lit(False)),
        "inside_word": spaced & F.coalesce(cuts, F.lit(False)),
        "no_overlap": (F.col("chunk_index") > 0) & F.coalesce(start >= F.col("before_end"), F.lit(False)),
    }
    named = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in faults.items())), lambda x: x.isNotNull())
    return rows.withColumn("faults", named).filter(F.size("faults") > 0).drop("before_end")


def recut(pieces: DataFrame, passages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """id, document_id, faults, pieces: each stored piece that breaks the rules with the pieces that its
    passage is cut into instead (those that share characters with it, all if its offsets are wrong)."""
    broken = broken_pieces(pieces, passages, limit)
    made = _pieces_udf(limit, overlap)(F.coalesce("passage", F.lit("")), F.col("language"))
    new = broken.select("id", "document_id", "faults", "char_start", "char_end", made.alias("made"))
    meets = F.filter("made", lambda x: F.array_contains("faults", "offsets") | ((x["char_start"] < F.col("char_end")) & (x["char_end"] > F.col("char_start"))))
    return new.select("id", "document_id", "faults", meets.alias("pieces"))
