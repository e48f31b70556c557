"""Character similarity of two texts: an upper bound as an expression, and the sequence ratio as an Arrow batch function.

The ratio of matched characters can't exceed that of the characters two texts have in common, in whatever order. The
counts of a text's characters are an array that is made once a text (`profile`); the bound of a pair is a sum over two
such arrays, and only pairs that pass it are worth the ratio.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from difflib import Match, SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

#: Characters that are counted each by itself; all others count as one.
COUNTED = " 0123456789abcdefghijklmnopqrstuvwxyz"


class _Matcher(SequenceMatcher):
    """A sequence matcher that walks only over characters that can begin a match; blocks are those of the base class.

    As there, characters that make up more than a hundredth of a later text of 200 or more begin none, so few places of
    either text are left. They are found at once, and kept for the next earlier text.
    """

    def __init__(self):
        super().__init__(None, "", "")

    def set_seq1(self, a: str) -> None:
        super().set_seq1(a)
        self.places = None

    def set_seq2(self, b: str) -> None:
        if b == self.b:
            return
        self.b, self.matching_blocks, self.opcodes, self.fullbcount, self.places = b, None, None, None, None
        self.bjunk, self.bpopular = set(), set()
        codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), "uint32")
        kinds, counts = np.unique(codes, return_counts=True)
        if len(b) >= 200:
            kinds = kinds[counts <= len(b) // 100 + 1]
        self.b2j = {chr(c): np.flatnonzero(codes == c).tolist() for c in kinds}

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None) -> Match:
        a, b, b2j = self.a, self.b, self.b2j
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        if self.places is None:
            self.places = [i for i, c in enumerate(a) if c in b2j]
        i, j, n = alo, blo, 0
        before, last = {}, -2
        for p in self.places[bisect_left(self.places, alo) : bisect_left(self.places, ahi)]:
            known = before if p == last + 1 else {}
            before, last = {}, p
            js = b2j[a[p]]
            for q in js[bisect_left(js, blo) : bisect_left(js, bhi)]:
                k = before[q] = known.get(q - 1, 0) + 1
                if k > n:
                    i, j, n = p - k + 1, q - k + 1, k
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        return Match(i, j, n)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts in [0, 1]; 0 where one is missing or empty. Not symmetric: current first, earlier second."""
    known: dict[tuple, float] = {}  # equal pairs of a batch are matched once
    match, out = _Matcher(), []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = _ratio(match, *pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


#: The ratio where rows are then filtered by it: were it called deterministic, Spark would match pairs once for the filter and once for the result.
ratio_once = F.pandas_udf(ratio.func, DoubleType()).asNondeterministic()


def _ratio(match: _Matcher, x: str, y: str) -> float:
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    match.set_seq2(y)
    match.set_seq1(x)
    return match.ratio()


@F.pandas_udf(DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio where it is at least some value, else null; most pairs below it are told without matching them to the end."""
    return pd.Series([_ratio_from(x, y, v) for x, y, v in zip(a, b, least, strict=True)], dtype="float64")


def _ratio_from(x: str, y: str, least: float) -> float | None:
    """Each stretch left and right of a match can add no more than the characters that both its sides have in common."""
    if not x or not y:
        return None if least > 0 else 0.0
    total = len(x) + len(y)
    if x == y or total < 400:
        r = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
        return r if r >= least else None
    kinds = sorted({*x, *y})
    counts = [np.vstack([np.zeros(len(kinds), "int32"), np.cumsum(np.frombuffer(s.encode("utf-32-le"), "uint32")[:, None] == np.array([ord(c) for c in kinds], "uint32"), axis=0, dtype="int32")]) for s in (x, y)]
    most = lambda a, b, c, d: int(np.minimum(counts[0][b] - counts[0][a], counts[1][d] - counts[1][c]).sum())
    match, found = SequenceMatcher(None, x, y), 0
    left = most(0, len(x), 0, len(y))
    open_ = [(-left, 0, len(x), 0, len(y))]
    while open_:
        if 2.0 * (found + left) / total < least:
            return None
        n, a, b, c, d = heapq.heappop(open_)
        left += n
        i, j, k = match.find_longest_match(a, b, c, d)
        if k:
            found += k
            for part in ((a, i, c, j), (i + k, b, j + k, d)):
                if part[0] < part[1] and part[2] < part[3] and (more := most(*part)):
                    left += more
                    heapq.heappush(open_, (-more, *part))
    r = 2.0 * found / total
    return r if r >= least else None


#: The place of each ASCII character's count in a profile; all other characters count at the last place.
_PLACES = np.full(129, len(COUNTED), "uint8")
_PLACES[[ord(c) for c in COUNTED]] = np.arange(len(COUNTED))


@F.pandas_udf(ArrayType(IntegerType()))
def profile(x: pd.Series) -> pd.Series:
    """How often each counted character occurs, the others together last; nulls count as empty."""
    return pd.Series([_profile(s) if s else [0] * (len(COUNTED) + 1) for s in x], dtype=object)


def _profile(s: str) -> list[int]:
    codes = np.frombuffer(s.encode(), "uint8") if s.isascii() else np.minimum(np.frombuffer(s.encode("utf-32-le"), "uint32"), 128)
    return np.bincount(_PLACES[codes], minlength=len(COUNTED) + 1).tolist()


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio of two texts can be at most, from their profiles; 0 where one is empty."""
    add = lambda p: F.aggregate(p, F.lit(0), lambda s, n: s + n)
    both = add(F.zip_with(a, b, lambda m, n: F.least(m, n)))
    return F.when((add(a) > 0) & (add(b) > 0), 2 * both / (add(a) + add(b))).otherwise(0.0)


def sorted_words(x: Column) -> Column:
    """A text's words in order, one blank between them."""
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """The ratio of two texts whose words are put in order first: texts that only swap words are alike."""
    return ratio(sorted_words(a), sorted_words(b))
