"""Problem 1: cut oversized texts into pieces under a token limit, at natural boundaries, with overlap.

Method: dynamic programming over boundary positions. The cost of a segmentation is the sum of its
cut penalties (paragraph < sentence < line < clause < word) and of the squared deviation of each
piece from the item's even size, subject to the maximum length and the overlap.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are separated by these characters only; a no-break space is part of a word.
WORD = r"[^ \t\r\n]+"
_WORD = re.compile(WORD)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_LINE = re.compile(r"\n")
#: A mark at the end of a word, perhaps before a closing quote or bracket.
_STOP = re.compile(r"[.!?…][\"')\]”’»]?(?=[ \t\r\n])")
_CLAUSE = re.compile(r"[,;:][\"')\]”’»]?(?=[ \t\r\n])")
_ABBREVIATION = re.compile(
    r"(?:^|[(\[])(?:dr|mr|mrs|ms|prof|st|vs|e\.g|i\.e|etc|al|fig|no|incl|approx|dept|pt|resp|cf|z\.b|bzw|sr|sra|mme|[a-z])\.$",
    re.I,
)

KINDS = ("paragraph", "sentence", "line", "clause", "word", "end")
PENALTY = np.array([0.0, 1.0, 60.0, 400.0, 3000.0, 0.0])


@dataclass(frozen=True)
class SplitParams:
    """``max_tokens`` and ``overlap_tokens`` are estimates: the floor of ``tokens_per_word`` times the words."""

    max_tokens: int = 512
    overlap_tokens: int = 64
    tokens_per_word: float = 1.3
    balance: float = 8.0

    def words_for(self, tokens: int) -> int:
        """Most words whose estimate is at most ``tokens``."""
        w = int(tokens / self.tokens_per_word) + 2
        while w > 0 and math.floor(self.tokens_per_word * w) > tokens:
            w -= 1
        return max(w, 0)

    @property
    def max_words(self) -> int:
        return max(1, self.words_for(self.max_tokens))

    @property
    def overlap_words(self) -> int:
        return min(self.words_for(self.overlap_tokens), self.max_words - 1)


def boundary_kinds(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the index into ``KINDS`` of the boundary after it."""
    n = len(starts)
    kinds = np.full(n, 4, dtype=np.int8)

    def after(pattern: re.Pattern) -> np.ndarray:
        """The words that end where a match begins or, for marks inside words, ends."""
        at = np.array([m.end() for m in pattern.finditer(text)], dtype=np.int64)
        i = np.searchsorted(ends, at)
        i = np.minimum(i, n - 1)
        return i[ends[i] == at]

    kinds[after(_CLAUSE)] = 3
    gaps = np.array([m.start() for m in _LINE.finditer(text)], dtype=np.int64)
    i = np.searchsorted(ends, gaps, side="right") - 1
    kinds[i[i >= 0]] = 2
    for k in after(_STOP).tolist():
        if k < n - 1 and not text[starts[k + 1]].islower() and not _ABBREVIATION.search(text[starts[k] : ends[k]]):
            kinds[k] = 1
    gaps = np.array([m.start() for m in _PARAGRAPH.finditer(text)], dtype=np.int64)
    i = np.searchsorted(ends, gaps, side="right") - 1
    kinds[i[i >= 0]] = 0
    kinds[n - 1] = 5
    return kinds


def plan_cuts(kinds: np.ndarray, p: SplitParams) -> list[tuple[int, int]]:
    """Word ranges [start, end) of the pieces, of least cost; ``kinds`` as from :func:`boundary_kinds`.

    Candidate ends are the paragraph and sentence ends; where two of these lie too far apart for any
    piece to span them, the weaker boundaries between them are candidates too, at their penalties.
    """
    n, most, lap = len(kinds), p.max_words, p.overlap_words
    if n <= most:
        return [(0, n)]
    step = most - lap
    strong = np.flatnonzero(kinds <= 1) + 1
    strong = np.unique(np.concatenate(([0], strong, [n])))
    cand = [strong]
    for a, b in zip(strong[:-1], strong[1:], strict=True):
        if b - a > step:
            cand.append(np.arange(a + 1, b))
    cand = np.unique(np.concatenate(cand))
    # start of the piece after a cut: the first sentence start inside the overlap window, else its first word
    first = np.searchsorted(strong, np.maximum(cand - lap, 0), side="left")
    begin = np.where(strong[first] < cand, strong[first], np.maximum(cand - lap, 0))
    begin[0] = 0
    begin = np.maximum.accumulate(begin)
    pieces = math.ceil((n - lap) / step)
    even = (n + (pieces - 1) * lap) / pieces
    cost = np.full(len(cand), np.inf)
    cost[0] = 0.0
    back = np.zeros(len(cand), dtype=np.int64)
    pen = np.concatenate(([0.0], PENALTY[kinds[cand[1:] - 1]])) + 1e-6
    pen[-1] = 1e-6
    unbalance = p.balance * ((np.arange(most + 1) - even) / even) ** 2  # by size
    lows = np.searchsorted(begin, cand - most, side="left").tolist()
    for j, e in enumerate(cand.tolist()):
        lo = lows[j]
        if not j or lo >= j:
            continue
        c = unbalance[e - begin[lo:j]]
        c += cost[lo:j]
        k = int(c.argmin())
        cost[j] = c[k] + pen[j]
        back[j] = lo + k
    out, j = [], len(cand) - 1
    while j > 0:
        i = int(back[j])
        out.append((int(begin[i]) if i else 0, int(cand[j])))
        j = i
    return out[::-1]


def cut_text(text: str, p: SplitParams) -> list[tuple[int, int, int, int, str]]:
    """Pieces of ``text`` as (char start, char end, tokens, words shared with the piece before, kind of end).

    Pieces cover the text: the first begins at 0, the last ends at ``len(text)``, and white space
    after a piece's last word belongs to that piece.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return [(0, len(text), 0, 0, "end")]
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    kinds = boundary_kinds(text, starts, ends)
    out, before = [], 0
    for a, b in plan_cuts(kinds, p):
        s = 0 if a == 0 else int(starts[a])
        e = len(text) if b == len(starts) else int(starts[b])
        out.append((s, e, math.floor(p.tokens_per_word * (b - a)), max(0, before - a), KINDS[kinds[b - 1]]))
        before = b
    return out


_PIECE = "array<struct<char_start:int,char_end:int,token_count:int,overlap_words:int,cut_kind:string>>"


def split_oversized(df: DataFrame, text_col: str, params: SplitParams = SplitParams()) -> DataFrame:
    """Pieces of every row whose text is larger than ``params.max_tokens``.

    All columns of ``df`` stay; the new ones are ``piece_index`` (from 0), ``n_pieces``, ``char_start``,
    ``char_end``, ``token_count``, ``overlap_words``, ``cut_kind`` and ``piece``. Columns of ``df``
    under these names are replaced. Rows with null, empty or small texts give no row (they need no
    cut). Whole texts are used, however long. Words that are larger than the limit cannot occur,
    since a word counts as one. No shuffle: the size test runs in the JVM and only oversized texts
    reach Python, which returns offsets; the pieces are sliced in the JVM.
    """
    p = params
    new = ["piece_index", "n_pieces", "char_start", "char_end", "token_count", "overlap_words", "cut_kind", "piece"]
    src = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new or c == text_col])
    text = F.col(f"`{text_col}`")
    words = F.regexp_count(text, F.lit(WORD))
    big = src.where(F.length(text) > 2 * p.max_words).where(
        F.floor(F.lit(float(p.tokens_per_word)) * words) > p.max_tokens
    )

    @F.pandas_udf(_PIECE)
    def cut(s: pd.Series) -> pd.Series:
        names = ("char_start", "char_end", "token_count", "overlap_words", "cut_kind")
        return s.map(lambda t: [dict(zip(names, x, strict=True)) for x in cut_text(t, p)])

    # called nondeterministic, the function is not copied into the filters that other operators push down
    out = big.withColumn("_pieces", cut.asNondeterministic()(text)).withColumn("n_pieces", F.size("_pieces"))
    keep = [F.col(f"`{c}`") for c in src.columns if c not in new]
    return out.select("*", F.posexplode("_pieces").alias("piece_index", "_p")).select(
        *keep,
        "piece_index",
        "n_pieces",
        *[F.col(f"_p.{c}").alias(c) for c in ("char_start", "char_end", "token_count", "overlap_words", "cut_kind")],
        F.substring(text, F.col("_p.char_start") + 1, F.col("_p.char_end") - F.col("_p.char_start")).alias("piece"),
    )
