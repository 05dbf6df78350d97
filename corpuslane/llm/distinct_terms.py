"""Problem 6: how distinctive a term is of its record.

Method: graph-of-words weighting. Each record's terms form a graph whose edges join terms that occur
within a window; a term's weight is its number of distinct neighbours, times its rarity ln(N/d) in
the collection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.session import materialize

_TERM = re.compile(r"[a-z]{3,}")
#: Terms in more than 1/HOT of all (record, term) rows, of which there are at most HOT, join by broadcast.
HOT = 2000

_GRAPH = "id string, terms array<string>, counts array<int>, degrees array<int>"


def _graph(lists: pa.ListArray, ids: pa.Array, window: int) -> pa.RecordBatch:
    """Distinct terms per record with their counts and graph degrees, from ordered term lists."""
    off = lists.offsets.to_numpy().astype(np.int64)
    enc = lists.flatten().dictionary_encode()
    off = off - off[0]
    codes = enc.indices.to_numpy().astype(np.int64)
    n, v = len(ids), max(len(enc.dictionary), 1)
    rec = np.repeat(np.arange(n), np.diff(off))
    key = rec * v + codes
    terms, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    edges = []
    for d in range(1, window):
        same = rec[d:] == rec[:-d]
        a, b = at[:-d][same], at[d:][same]
        edges.append(np.minimum(a, b) * len(terms) + np.maximum(a, b))
    e = np.unique(np.concatenate(edges)) if edges and len(terms) else np.empty(0, np.int64)
    a, b = np.divmod(e, max(len(terms), 1))
    a, b = a[a != b], b[a != b]
    degree = np.bincount(a, minlength=len(terms)) + np.bincount(b, minlength=len(terms))
    out = pa.array(np.concatenate(([0], np.cumsum(np.bincount(terms // v, minlength=n)))).astype(np.int32))
    names = enc.dictionary.take(pa.array(terms % v)) if len(terms) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.ListArray.from_arrays(out, names.cast(pa.string())),
            pa.ListArray.from_arrays(out, pa.array(counts.astype(np.int32))),
            pa.ListArray.from_arrays(out, pa.array(degree.astype(np.int32))),
        ],
        names=["id", "terms", "counts", "degrees"],
    )


def _list(tokens: list[list[str]]) -> pa.ListArray:
    return pa.array(tokens, pa.list_(pa.string()))


def term_graph_of_texts(df: DataFrame, record: str, text: str, window: int) -> DataFrame:
    """Per row of ``df``: its terms (runs of three or more letters a-z of the lower-cased text), counts and degrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                c = b.slice(lo, 2000)
                yield _graph(_list([_TERM.findall(t.lower()) for t in c.column(1).to_pylist()]), c.column(0), window)

    return df.where(F.col(text).isNotNull()).select(F.col(record).cast("string").alias("id"), F.col(text).alias("t")).mapInArrow(run, _GRAPH)


def term_graph_of_lists(df: DataFrame, record: str, items: str, window: int) -> DataFrame:
    """Per row of ``df``: the items of an ordered list as terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _graph(_list(b.column(1).to_pylist()), b.column(0), window)

    return df.where(F.col(items).isNotNull()).select(F.col(record).cast("string").alias("id"), F.col(items).alias("t")).mapInArrow(run, _GRAPH)


def distinctiveness(graphs: DataFrame, n_records: DataFrame, keep=None) -> DataFrame:
    """(id, term, n, degree, d, n_records, score) for each term of each record.

    ``graphs`` comes from one of the functions above with one row per record, ``n_records`` is one row
    with the column n_records. ``keep`` is an optional condition on (n, degree, n_records) under which
    rows go on to the rarity join; d counts all records whatever ``keep`` says.
    score = degree x ln(N / d), 0 for a term that stands alone in its record. Records without a term
    give no row. Document frequencies are pre-aggregated in the tasks; terms so frequent that their
    rows would skew the join, a number bounded by ``HOT``, are joined by broadcast.
    """
    g = materialize(graphs, "term-graphs")
    freq = g.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("d"))
    freq = materialize(freq, "term-frequencies")
    total = freq.agg(F.sum("d")).first()[0] or 0
    rows = g.select("id", F.explode(F.arrays_zip("terms", "counts", "degrees")).alias("x")).select(
        "id", F.col("x.terms").alias("term"), F.col("x.counts").alias("n"), F.col("x.degrees").alias("degree")
    )
    rows = rows.crossJoin(F.broadcast(n_records))  # one row
    if keep is not None:
        rows = rows.where(keep)
    hot = freq.where(F.col("d") * HOT > total)
    first = rows.join(F.broadcast(hot), "term", "left")
    cols = ["id", "term", "n", "degree", "d", "n_records"]
    done = first.where("d is not null").select(cols)
    rest = first.where("d is null").drop("d").join(freq.where(F.col("d") * HOT <= total), "term").select(cols)
    return done.unionByName(rest).withColumn("score", F.col("degree") * F.ln(F.col("n_records").cast("double") / F.col("d")))
