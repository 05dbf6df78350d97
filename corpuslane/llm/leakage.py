"""Problem 8: evaluation passages inside a training corpus.

Method: an FM-index over each shard of training text. The shard's words are numbered, a suffix array
is built, its Burrows-Wheeler transform goes into a wavelet matrix, and the test phrases are found by
backward search; occurrences are located by sampled suffix positions and merged into removal spans.

Words that no test passage has can end no occurrence, so they only separate the runs that are
indexed, and runs shorter than a phrase are left out: both are exact.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_WORD = re.compile(r"[^\W_]+")

#: Characters of text that make up one shard.
SHARD_CHARS = 32_000_000
#: Bytes of test passages sent to the tasks at a time; more passages are searched in blocks.
BLOCK_BYTES = 32 << 20
#: Every so many text positions keep their suffix position.
SAMPLE = 8


def fold(text: str) -> str:
    """Lower-cased text without accents."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))


def words(text: str) -> list[str]:
    """Runs of letters or digits, lower-cased, without accents."""
    return _WORD.findall(fold(text))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character offsets in ``text`` of each of its :func:`words`."""
    if text.isascii():
        return [m.span() for m in _WORD.finditer(text)]
    out, at = [], []
    for i, c in enumerate(text):
        f = fold(c)
        out.append(f)
        at.extend([i] * len(f))
    at.append(len(text))
    # a word keeps the accents behind its last letter
    return [(at[m.start()], max(at[m.end() - 1] + 1, at[m.end()])) for m in _WORD.finditer("".join(out))]


class WaveletMatrix:
    """Rank over a sequence of small integers, all queries vectorised."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        s = seq
        for level in range(self.bits - 1, -1, -1):
            b = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(b, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate((s[b == 0], s[b == 1]))
        # where the run of each symbol begins after the last level
        c = np.arange(sigma)
        self.begin = self._walk(c, np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            r = self.ones[k][i]
            i = np.where((c >> level) & 1, self.zeros[k] + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c[k] occurs before position i[k]."""
        return self._walk(c, i) - self.begin[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators (0) count as distinct symbols in text order, below all others."""
    n = len(text)
    rank = text.astype(np.int64).copy()
    sep = np.flatnonzero(rank == 0)
    rank += len(sep)
    rank[sep] = np.arange(len(sep))
    h = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if int(new[-1]) == n - 1 or h >= n:
            return order
        h *= 2


class FMIndex:
    """Full-text index of a sequence whose symbol 0 separates runs; the sequence begins with 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        self.n = len(text)
        # the position after a separator is kept always, so no walk has to cross one
        kept = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.samples = sa[kept]
        self.kept = kept

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffix array that begin with each pattern (one per row of ``patterns``)."""
        p = len(patterns)
        lo, hi = np.zeros(p, np.int64), np.full(p, self.n, np.int64)
        live = np.arange(p)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live] = self.less[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.less[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows: walk back to a kept one."""
        at, out = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.arange(len(rows))
        for step in range(SAMPLE + 1):
            hit = self.kept[at[walk]]
            done = walk[hit]
            out[done] = self.samples[self.kept_before[at[done]]] + step
            walk = walk[~hit]
            if not len(walk):
                break
            c = self.bwt[at[walk]]
            at[walk] = self.less[c] + self.wavelet.rank(c, at[walk])
        return out


class Phrases:
    """All phrases of ``size`` words of the test passages, as word numbers, with the items they come from."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size = size
        self.ids: dict[str, int] = {}
        found: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, passage in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(passage)]
            for i in range(len(w) - size + 1):
                found[tuple(w[i : i + size])].add(item)
        self.patterns = np.array(list(found), dtype=np.int64).reshape(-1, size)
        owners = [sorted(x) for x in found.values()]
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int64)
        self.owners = np.array([y for x in owners for y in x], dtype=np.int64)

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(number of the text, item, merged word ranges) for one shard."""
        get, seq = self.ids.get, []
        for t in texts:
            if t:
                seq += [get(w, 0) for w in words(t)]
            seq.append(-1)  # end of a text
        s = np.array(seq, dtype=np.int64)
        del seq
        doc = np.cumsum(s == -1) - (s == -1)
        starts = np.concatenate(([0], np.flatnonzero(s == -1)[:-1] + 1))
        good = s > 0
        edge = np.diff(np.concatenate(([0], good.view(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= self.size
        a, b = a[long], b[long]
        if not len(a) or not len(self.patterns):
            return
        # the indexed text: 0, run, 0, run, ..., 0; ``back`` leads from it to positions in s
        sizes = b - a
        total = int(sizes.sum()) + len(a) + 1
        back = np.full(total, -1, np.int64)
        offset = np.repeat(np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) + 1 - a, sizes)
        inside = np.repeat(a - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
        back[inside + offset] = inside
        text = np.where(back >= 0, s[back], 0)
        index = FMIndex(text, len(self.ids) + 1)
        lo, hi = index.search(self.patterns)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        at = back[index.locate(rows)]
        # one row per occurrence and owner
        m = self.first[which + 1] - self.first[which]
        occ = np.repeat(np.arange(len(which)), m)
        own = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
        d, item, begin = doc[at[occ]], self.owners[own], at[occ] - starts[doc[at[occ]]]
        order = np.lexsort((begin, item, d))
        last = None
        for d1, i1, b1 in zip(d[order].tolist(), item[order].tolist(), begin[order].tolist(), strict=True):
            if last and last[:2] == (d1, i1):
                if b1 <= last[2][-1][1]:
                    last[2][-1] = (last[2][-1][0], b1 + self.size)
                else:
                    last[2].append((b1, b1 + self.size))
            else:
                if last:
                    yield last
                last = (d1, i1, [(b1, b1 + self.size)])
        if last:
            yield last


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    min_words: int = 12,
) -> DataFrame:
    """(doc_id, item_id, words, spans) for every document that holds ``min_words`` consecutive words of an item.

    words counts the document's words inside the spans, spans are merged character ranges to remove.
    Words compare lower-cased and without accents; all else between them is ignored. Null or empty
    texts and passages, and passages under ``min_words`` words, give no row; repeated rows give repeated
    results; ids are bigints. Whole texts are indexed; there is no shuffle. The test items travel to
    the tasks in blocks of at most ``BLOCK_BYTES``; a task searches its documents for one block after the other.
    """
    clean = items.where(F.col(passage).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).alias("p"))
    bulk = clean.agg(F.sum(F.octet_length("p") + 16)).first()[0] or 0
    blocks = max(1, -(-bulk // BLOCK_BYTES))
    context = docs.sparkSession.sparkContext
    shared = []
    for k in range(blocks):
        mine = clean if blocks == 1 else clean.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        shared.append(context.broadcast([(r["i"], r["p"]) for r in mine.collect()]))
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return _find(d, shared, min_words)


def _find(d: DataFrame, shared: list, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Phrases(shared[0].value, min_words) if len(shared) == 1 else None

        def shard(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
            # a shard is read once, whatever the number of blocks
            for block in shared:
                yield from search(only or Phrases(block.value, min_words), ids, texts)

        def search(phrases: Phrases, ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            known: dict[int, list] = {}
            for n, item, ranges in phrases.leaks(texts):
                if n not in known:
                    known = {n: word_spans(texts[n])}
                w = known[n]
                spans = [{"start": w[a][0], "end": w[b - 1][1]} for a, b in ranges]
                rows.append((ids[n], item, sum(b - a for a, b in ranges), spans))
            if rows:
                a, b, c, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(s, _SPANS)],
                    names=["doc_id", "item_id", "words", "spans"],
                )

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= SHARD_CHARS:
                    yield from shard(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield from shard(ids, texts)

    return d.mapInArrow(run, "doc_id bigint, item_id bigint, words int, spans array<struct<start:int,end:int>>")
