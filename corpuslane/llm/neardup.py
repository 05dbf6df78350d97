"""Problem 3: near-duplicate texts with small edits.

Method: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate
edges. The centres of a bucket's stars are chosen one after the other, by hash, among the texts that
are not close to an earlier centre; every text of the bucket is compared with every centre, and what
the signatures do not rule out is a candidate and is checked exactly. Two texts of a bucket that were
not compared are thus close to centres; where a close link and another link meet, the closure compares
their ends, until no link is new. Distances (one minus the similarity) keep the triangle inequality,
so the ends of two close links always reach the threshold: the closure's work is bounded by its result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.forest import spanning_forest
from corpuslane.session import materialize, release, small

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Texts of a bucket in one block. A larger bucket is cut into blocks, whose centres meet in the next level.
BLOCK = 1 << 13
#: Blocks whose centres are more than this share of their texts leave nothing to gain: every two of them are compared.
DISTINCT = 0.8
#: Edge of the tiles in which two blocks are compared.
TILE = 512


@dataclass(frozen=True)
class NearDupParams:
    """``shingle`` words make a shingle; pairs need a Jaccard similarity of ``threshold``.

    The signature has ``bands`` x ``rows`` bins. A pair of similarity s becomes a candidate with
    probability 1 - (1 - s ** rows) ** bands. ``slack`` standard errors below the threshold is where
    the signature rules a candidate out.
    """

    shingle: int = 5
    threshold: float = 0.8
    min_words: int = 40
    bands: int = 24
    rows: int = 4
    slack: float = 3.0

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    @property
    def close(self) -> float:
        """Two texts this similar to a third one reach the threshold with each other."""
        return (1 + self.threshold) / 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words(dict):
    """Hashes of words; forgets them when it grows large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def words(text: str) -> list[str]:
    """Runs of letters or digits, lower-cased."""
    return _WORD.findall(text.lower())


def _probes(bins: int, tries: int = 512) -> np.ndarray:
    """For each bin the bins from which it borrows while it is empty, the same for every text."""
    i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(tries, dtype=np.uint64), indexing="ij")
    with np.errstate(over="ignore"):
        return (_mix(i * _U(1_000_003) + t + _U(77)) % _U(bins)).astype(np.int64)


class Signer:
    """Signatures of a batch of texts."""

    def __init__(self, p: NearDupParams):
        self.p, self.cache, self.probes = p, _Words(), _probes(p.bins)

    def sign(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the texts with enough words, hash of each one's word sequence, bins as uint16)."""
        p, get = self.p, self.cache.__getitem__
        least = max(p.min_words, p.shingle)
        flat, sizes, which = [], [], []
        for k, t in enumerate(texts):
            w = words(t)
            if len(w) >= least:
                flat.extend(map(get, w))
                sizes.append(len(w))
                which.append(k)
        if not which:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, p.bins), np.uint16)
        h = np.array(flat, dtype=np.uint64)
        n = np.array(sizes)
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        with np.errstate(over="ignore"):
            place = np.arange(len(h), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64)
            content = np.add.reduceat(_mix(h + _mix(place + _U(11))), first)
            s = np.zeros(len(h) - p.shingle + 1, np.uint64)
            for k in range(p.shingle):
                s = s * _U(0x9E3779B97F4A7C15) + h[k : k + len(s)]
            s = _mix(s)
        doc = np.repeat(np.arange(len(n)), n)
        inside = np.ones(len(h), bool)
        for k in range(1, p.shingle):
            inside[first + n - k] = False
        inside = inside[: len(s)]
        s, doc = s[inside], doc[: len(inside)][inside]
        bin_ = ((s >> _U(32)) * _U(p.bins)) >> _U(32)
        key = ((doc.astype(np.uint64) * _U(p.bins) + bin_) << _U(32)) | (s & _U(0xFFFFFFFF))
        key.sort()
        cell = key >> _U(32)
        head = np.concatenate(([True], cell[1:] != cell[:-1]))
        sig = np.full(len(n) * p.bins, _EMPTY)
        sig[cell[head].astype(np.int64)] = key[head] & _U(0xFFFFFFFF)
        sig = sig.reshape(len(n), p.bins)
        full = sig.copy()
        d, b = np.nonzero(sig == _EMPTY)
        for t in range(self.probes.shape[1]):
            v = sig[d, self.probes[b, t]]
            got = v != _EMPTY
            full[d[got], b[got]] = v[got]
            d, b = d[~got], b[~got]
            if not len(d):
                break
        return np.array(which), content.view(np.int64), (full & _U(0xFFFF)).astype(np.uint16)


def _sign_all(docs: DataFrame, p: NearDupParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(p)
        for b in batches:
            for lo in range(0, b.num_rows, 2500):
                c = b.slice(lo, 2500)
                which, content, sig = signer.sign(c.column(1).to_pylist())
                raw = sig.view(np.uint8).reshape(len(which), -1)
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(p.bins * 2), len(which), [None, pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays(
                    [c.column(0).take(pa.array(which)), pa.array(content), blob.cast(pa.binary())], names=["node", "content", "sig"]
                )

    return docs.mapInArrow(run, "node bigint, content bigint, sig binary")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, node), sorted by key, whose key is not alone. Rows stream through, however many share a key."""
    last = None  # a row that waits for the next batch
    for b in batches:
        if not b.num_rows:
            continue
        key, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        seen = None
        if last is not None:
            key, node, seen = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], node)), last[2]
        same = key[1:] == key[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([seen == key[0]], same))
        last = (key[-1], node[-1], key[-1] if keep[-1] else None)
        keep = keep[:-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(node[:-1][keep])], names=["key", "node"])
    if last is not None and last[2] is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]])], names=["key", "node"])


def _band_rows(sigs: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, node): for each text and band one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            node = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, p.bands, p.rows).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), (n, p.bands)) * _U(0x9E3779B97F4A7C15)
                # the table is the lowest bit of a node, so tables never share a bucket
                key = key + (node & 1).astype(np.uint64)[:, None]
                for r in range(p.rows):
                    key = _mix(key + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, p.bands))], names=["key", "node"])

    return sigs.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def jaccard(a: str, b: str, shingle: int) -> float:
    """Similarity of two texts' distinct word sequences."""
    x, y = words(a), words(b)
    s = set(zip(*(x[i:] for i in range(shingle)), strict=False))
    t = set(zip(*(y[i:] for i in range(shingle)), strict=False))
    both = len(s & t)
    return both / (len(s) + len(t) - both) if both else 0.0


def _least_equal(p: NearDupParams) -> int:
    """Equal bins that a pair needs, else its signatures rule it out."""
    least = p.threshold - p.slack * (p.threshold * (1 - p.threshold) / p.bins) ** 0.5
    return int(np.ceil(least * p.bins))


def _low(sig: str) -> Column:
    """An eight-bit part of each bin."""

    @F.pandas_udf("binary")
    def low(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x[::2])

    return low(sig)


def _tiles(node: np.ndarray, sig: np.ndarray, other: np.ndarray, other_sig: np.ndarray, least: int, same: bool) -> Iterator[np.ndarray]:
    """Pairs of two blocks, or of one block with itself, that have ``least`` equal bins."""
    for i in range(0, len(node), TILE):
        x = np.ascontiguousarray(sig[i : i + TILE].T)
        for k in range(i if same else 0, len(other), TILE):
            y = np.ascontiguousarray(other_sig[k : k + TILE].T)
            equal = np.zeros((x.shape[1], y.shape[1]), np.uint16 if len(x) > 255 else np.uint8)
            for u, v in zip(x, y, strict=True):
                equal += u[:, None] == v
            r, c = np.nonzero(equal >= least)
            if same and i == k:
                r, c = r[r < c], c[r < c]
            yield np.stack((node[i + r], other[k + c]), 1)


def stars(node: np.ndarray, sig: np.ndarray, least: int, close: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, centres) of one block: each centre with all texts that have ``least`` equal bins with it.

    The next centre is the first text, by a hash, that has fewer than ``close`` equal bins with all centres so far.
    """
    with np.errstate(over="ignore"):
        order = np.argsort(_mix(node.astype(np.uint64) + sig[:, 0].astype(np.uint64)), kind="stable")
    node, sig = node[order], sig[order]
    open_ = np.ones(len(node), bool)
    pairs, centres, at = [], [], 0
    while at < len(node):
        if open_[at]:
            equal = np.add.reduce(sig == sig[at], axis=1, dtype=np.uint16)
            open_ &= equal < close
            equal[at] = 0
            hit = np.flatnonzero(equal >= least)
            pairs.append(np.stack((np.full(len(hit), node[at]), node[hit]), 1))
            centres.append(node[at])
        at += 1
    return np.concatenate(pairs), np.array(centres)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole runs of equal keys (the first columns) from sorted batches: several runs at a time, each complete."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        new = (*(b.column(k).to_numpy() for k in range(b.num_columns - 1)), np.frombuffer(b"".join(b.column(b.num_columns - 1).to_pylist()), np.uint8).reshape(b.num_rows, -1))
        rows = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new, strict=True))
        differ = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in rows[:keys]]))
        cut = differ[-1] + 1 if len(differ) else 0
        kept = tuple(x[cut:] for x in rows)
        if cut:
            yield tuple(x[:cut] for x in rows)
    if kept is not None:
        yield kept


def _cuts(*keys: np.ndarray) -> Iterator[slice]:
    """The runs of equal keys."""
    change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.concatenate(([0], np.flatnonzero(change) + 1, [len(keys[0])])).tolist()
    return (slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True))


def _edge_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1)), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "key"])


def _candidates(sigs: DataFrame, p: NearDupParams) -> DataFrame:
    """(a < b): the star edges of all buckets whose signatures do not rule them out.

    Blocks of a bucket larger than ``BLOCK`` hand their centres to the next level, where these are one
    bucket again, in blocks of other texts.
    """
    least = _least_equal(p)
    # what the signatures call close has to be close indeed, since the closure relies on it
    close = int(np.ceil((p.close + p.slack * (p.close * (1 - p.close) / p.bins) ** 0.5) * p.bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, blocks, node, sig in _runs(batches, 2):
            found = []
            for s in _cuts(key, own):
                pairs, centres = stars(node[s], sig[s], least, close)
                found.append(pairs)
                if blocks[s.start] > 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(centres), pa.nulls(len(centres), pa.int64()), pa.array(np.full(len(centres), key[s.start]))], names=["a", "b", "key"]
                    )
            yield _edge_batch(np.unique(np.concatenate(found), axis=0))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, i, k, own, node, sig in _runs(batches, 3):
            for s in _cuts(key, i, k):
                first, n, g = own[s] == i[s.start], node[s], sig[s]
                whole = i[s.start] == k[s.start]
                rest = first if whole else ~first
                for x in _tiles(n[first], g[first], n[rest], g[rest], least, whole):
                    if len(x):
                        yield _edge_batch(x)

    edge = "a bigint, b bigint, key bigint"
    sorted_ = _band_rows(sigs, p).repartition("key").sortWithinPartitions("key")
    members = shared = materialize(sorted_.mapInArrow(_repeated, "key bigint, node bigint"), "buckets")
    low = sigs.select("node", _low("sig").alias("s"))
    levels = []
    while True:
        # keys with more than BLOCK texts; there are at most as many as blocks in the whole table
        hot = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot-buckets")
        many = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))
        own = F.pmod(F.xxhash64("node", F.lit(len(levels))), many)
        blocked = members.join(small(hot, 16), "key", "left").select("key", "node", many.alias("blocks"), own.alias("own"))
        placed = blocked.join(low, "node").select("key", "own", "blocks", "node", "s")
        out = materialize(placed.repartition("key", "own").sortWithinPartitions("key", "own").mapInArrow(run, edge), "stars")
        levels.append(out.where("b is not null").select("a", "b"))
        if hot.isEmpty():
            break
        before = hot.agg(F.sum("n")).first()[0]
        members = out.where("b is null").select("key", F.col("a").alias("node"))
        if members.count() > DISTINCT * before:
            n = members.groupBy("key").agg(F.count("*").alias("n"))
            many = F.ceil(F.col("n") / BLOCK)
            cut = members.join(F.broadcast(hot.select("key").join(n, "key")), "key").withColumn("blocks", many).withColumn("own", F.pmod(F.xxhash64("node"), many))
            met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).join(low, "node")
            parts = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"), "own", "node", "s")
            levels.append(parts.repartition("key", "i", "k").sortWithinPartitions("key", "i", "k").mapInArrow(every, edge).select("a", "b"))
            break
    found = levels[0]
    for x in levels[1:]:
        found = found.unionByName(x)
    found = materialize(found.distinct(), "candidates")
    release(shared)
    return found


def _weigh(edges: DataFrame, sigs: DataFrame, p: NearDupParams) -> DataFrame:
    """Edges whose signatures (node, s) do not rule them out."""
    least = _least_equal(p)

    @F.pandas_udf("int")
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
        return pd.Series((x == y).sum(axis=1, dtype=np.int32))

    j = edges.join(sigs.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        sigs.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"
    )
    return j.where(equal("sa", "sb") >= least).select("a", "b")


def _grams(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """(node, g): the distinct word sequences of each text, as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                h = np.array([cache[w] for w in words(t)], np.uint64)
                s = np.zeros(max(0, len(h) - p.shingle + 1), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(p.shingle):
                        s = s * _U(0x9E3779B97F4A7C15) + h[k : k + len(s)]
                rows.append(np.unique(_mix(s)).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "g"])

    return docs.select("node", "text").mapInArrow(run, "node bigint, g array<bigint>")


def _check(edges: DataFrame, grams: DataFrame, p: NearDupParams, name: str) -> DataFrame:
    """Edges of texts that truly reach the threshold, with the similarity."""
    j = edges.join(grams.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a").join(
        grams.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b"
    )
    both = F.size(F.array_intersect("ga", "gb"))
    j = j.select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).alias("n"))
    return materialize(
        j.select("a", "b", (F.col("both") / (F.col("n") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= p.threshold), name
    )


@dataclass
class NearDups:
    """Result of :func:`near_duplicates`.

    sigs: (node, content, sig) of all texts with enough words; copies: (node, rep), every text that
    repeats another's words, with its representative; links: (a < b, similarity) between representatives.
    """

    sigs: DataFrame
    copies: DataFrame
    links: DataFrame

    def members(self) -> DataFrame:
        """(rep, node) of every class of copies, the representative included."""
        reps = self.copies.select("rep").distinct()
        return self.copies.select("rep", "node").unionByName(reps.select("rep", F.col("rep").alias("node")))


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), closed: bool = True) -> NearDups:
    """Classes of copies and links between different texts, from (node bigint, text).

    ``node`` is unique; its lowest bit names the table, and tables are not compared with each other.
    Null texts and texts under ``min_words`` words take no part. Rows that repeat a node are undefined.
    Texts of the same words are put into one class first (by hash), so that a hot text costs no
    candidates; a class is represented by its smallest node. ``closed`` asks for all links; without it
    the links are those to the centres, which suffice for groups and grow with the texts only.

    The texts are read twice: once for signatures, once for the word sequences of those that have a candidate.
    """
    p = params
    live = docs.where(F.col("text").isNotNull() & (F.length("text") >= 2 * p.min_words - 1)).select("node", "text")
    sigs = materialize(_sign_all(live, p), "signatures")
    table = F.col("node").bitwiseAND(F.lit(1))
    groups = sigs.groupBy("content", table.alias("t")).agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("content", "t", "rep"), "copy-groups")
    copies = materialize(
        sigs.select("node", "content", table.alias("t")).join(small(groups, 24), ["content", "t"]).where("node != rep").select("node", "rep"), "copies"
    )
    release(groups)
    reps = sigs.join(small(copies.select("node"), 16), "node", "left_anti")
    edges = _candidates(reps, p)
    ids = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate-ids")
    grams = materialize(_grams(live.join(small(ids, 16), "node", "left_semi"), p), "grams")
    links = _check(edges, grams, p, "links")
    release(edges, ids)
    if not closed:
        return NearDups(sigs, copies, links)
    linked = materialize(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "linked")
    low = materialize(sigs.join(small(linked, 16), "node", "left_semi").select("node", _low("sig").alias("s")), "linked-signatures")
    fresh, seen = links, links.select("a", "b").where("false")
    while True:
        both, near = (
            x.select(F.col("a").alias("c"), F.col("b").alias("y"), "similarity").unionByName(x.select(F.col("b").alias("c"), F.col("a").alias("y"), "similarity"))
            for x in (links, fresh)
        )
        hop = (
            near.withColumnsRenamed({"y": "x", "similarity": "sx"})
            .join(both, "c")
            .where((F.col("x") != F.col("y")) & (F.greatest("sx", "similarity") >= p.close))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
            .join(links.select("a", "b"), ["a", "b"], "left_anti")
            .join(seen, ["a", "b"], "left_anti")
        )
        hop = materialize(hop, "hops")
        if hop.isEmpty():
            break
        fresh = _check(_weigh(hop, low, p), grams, p, "links")
        seen = seen.unionByName(hop)
        if fresh.isEmpty():
            break
        links = links.unionByName(fresh)
    return NearDups(sigs, copies, links)


def all_pairs(r: NearDups) -> DataFrame:
    """(a < b): every pair of texts that are copies or linked, copies written out.

    This is the expanded form; its size is that of the result asked for. :func:`groups` is the compact one.
    """
    m = r.members()
    nodes = r.links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    single = nodes.join(m.select("rep").distinct(), "rep", "left_anti").select("rep", F.col("rep").alias("node"))
    of = m.unionByName(single)
    across = (
        r.links.select("a", "b")
        .join(of.select(F.col("rep").alias("a"), F.col("node").alias("x")), "a")
        .join(of.select(F.col("rep").alias("b"), F.col("node").alias("y")), "b")
    )
    within = m.select("rep", F.col("node").alias("x")).join(m.select("rep", F.col("node").alias("y")), "rep").where("x < y")
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within.select(F.col("x").alias("a"), F.col("y").alias("b")))


def groups(r: NearDups) -> DataFrame:
    """(node, class_id, rep): every text with enough words, its group, and the text that it copies (else itself)."""
    _, labels = spanning_forest(r.links.select("a", "b"), "groups")
    smallest = labels.groupBy("root").agg(F.min("v").alias("class_id"))
    named = labels.join(smallest, "root").select(F.col("v").alias("rep"), "class_id")
    return (
        r.sigs.select("node")
        .join(r.copies, "node", "left")
        .select("node", F.coalesce("rep", "node").alias("rep"))
        .join(named, "rep", "left")
        .select("node", F.coalesce("class_id", "rep").alias("class_id"), "rep")
    )
