"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of boundaries from the coarsest to the finest.
KINDS = ("paragraph", "line", "sentence", "word")
# Code points of white space, of line breaks, of full stops, and of what may close a sentence behind one.
SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BREAKS = (*range(0x0A, 0x0E), 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)
STOPS, CLOSERS = tuple(map(ord, ".!?")), tuple(map(ord, "'\"’”»)]}›"))
_TOP = 0x3001  # no sign of these lies higher


def _mask(points: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(_TOP + 1, dtype=bool)
    out[list(points)] = True
    return out


_WHITE, _BREAK, _STOP, _CLOSE = map(_mask, (SPACES, BREAKS, STOPS, CLOSERS))


class Offsets:
    """What a text can be cut by: sorted arrays of boundary offsets, and where it is filled.

    All come from masks over the code points. A boundary lies behind its white space: a paragraph's
    behind the last break of white space with two or more, a line's behind each break (a
    carriage return and line feed are one), a sentence's behind white space that follows a
    full stop and what closes it, a word's behind any white space.
    """

    def __init__(self, text: str):
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _TOP)
        self.n = n = len(codes)
        white = _WHITE[codes]
        edge = np.diff(white.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        broken = _BREAK[codes]
        broken[:-1] &= ~((codes[:-1] == 13) & (codes[1:] == 10))
        lines = np.flatnonzero(broken) + 1
        first, last = np.searchsorted(lines, begins, side="right"), np.searchsorted(lines, ends, side="right")
        before = np.arange(n)
        before[_CLOSE[codes]] = -1
        solid = np.maximum.accumulate(before) if n else before  # the last offset that closes nothing, at or before each
        ahead = solid[begins[begins > 0] - 1]
        stopped = np.zeros(len(begins), dtype=bool)
        stopped[begins > 0] = (ahead >= 0) & _STOP[codes[ahead]]
        self.marks = {"paragraph": lines[last[last - first >= 2] - 1], "line": lines, "sentence": ends[stopped], "word": ends}
        self.filled = np.flatnonzero(~white)

    def longest_stretch(self, cuts: np.ndarray) -> int:
        """Length of the longest stretch between sorted cuts; white space at its ends doesn't count."""
        if not len(self.filled):
            return 0
        edges = np.concatenate([[0], cuts, [self.n]])
        first = np.searchsorted(self.filled, edges[:-1])
        last = np.searchsorted(self.filled, edges[1:]) - 1
        some = last >= first
        return int((self.filled[last[some]] - self.filled[first[some]] + 1).max(initial=0))

    def finest_needed(self, limit: int) -> str:
        """The first kind such that cutting at it and all earlier kinds leaves no stretch over ``limit``."""
        cuts = np.empty(0, dtype=np.int64)
        for kind in KINDS:
            cuts = np.union1d(cuts, self.marks[kind])
            if self.longest_stretch(cuts) <= limit:
                return kind
        return "none"

    def last_under(self, least: int, reach: int) -> tuple[int, str]:
        """The last boundary in [least, reach] of the coarsest kind that has one, by binary search; else a hard cut at ``reach``."""
        for kind in KINDS:
            at = int(np.searchsorted(self.marks[kind], reach, side="right")) - 1
            if at >= 0 and self.marks[kind][at] >= least:
                return int(self.marks[kind][at]), kind
        return reach, "hard"


def finest_needed(text: str, limit: int) -> str:
    return Offsets(text).finest_needed(limit)


def split(text: str, limit: int, overlap: int, sizes: list[int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pieces of ``text``, each at most ``limit`` large.

    ``sizes`` gives the size of each character (by default 1; with a tokenizer, the tokens
    that begin in it); their prefix sums turn the limit into an offset by binary search.
    A piece ends behind the last boundary of the coarsest kind under the limit that lets it
    go on beyond the overlap, else in a hard cut (``hard``); the next one starts ``overlap``
    before that end. The last piece's kind is ``end``. An empty text has no pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    total = np.concatenate([[0], np.cumsum(sizes if sizes is not None else np.ones(n, dtype=np.int64))])
    offsets = Offsets(text) if total[-1] > limit else None
    pieces, start = [], 0
    while start < n:
        reach = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
        if reach >= n:
            pieces.append((start, n, "end"))
            break
        least = int(np.searchsorted(total, total[start] + overlap, side="right"))
        end, kind = offsets.last_under(max(least, start + 1), reach)
        pieces.append((start, end, kind))
        start = max(start + 1, int(np.searchsorted(total, total[end] - overlap, side="left")))
    return pieces


def passage_boundaries(passages: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, boundary) of each text longer than ``limit`` characters; repeated rows count once.

    The boundary is read off the boundary arrays that :func:`split` cuts by.

    Null, empty and short texts give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "boundary": [finest_needed(t, limit) for t in b["text"]]})

    long = passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    return long.mapInPandas(run, "id string, boundary string").distinct()


def passage_pieces(passages: DataFrame, id_col: str, text_col: str, start_col: str, limit: int, overlap: int) -> DataFrame:
    """(id, piece, start_char, end_char, cut, content): all texts in pieces of at most ``limit``.

    Offsets count from ``start_col`` (0 where null). Null and empty texts have no pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, k, int(base) + s, int(base) + e, kind, t[s:e])
                for i, t, base in zip(b["id"], b["text"], b["base"])
                for k, (s, e, kind) in enumerate(split(t, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["id", "piece", "start_char", "end_char", "cut", "content"])

    some = passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(start_col), F.lit(0)).alias("base")).where(F.length("text") > 0)
    return some.mapInPandas(run, "id string, piece int, start_char int, end_char int, cut string, content string").distinct()
