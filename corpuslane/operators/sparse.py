"""Sparse retrieval: an inverted index as tables, BM25."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import bm25_tokens

K1, B = 1.5, 0.75
#: Rows of query terms up to which they are sent to the postings; beyond, the two are shuffled by term and a share of the document.
QUERY_TERMS = 100_000
#: Parts into which a term's postings are spread in that shuffle, so that a frequent term is no single task.
SPREAD = 16


@dataclass
class SparseIndex:
    """postings: (term, doc_id, tf, dl); terms: (term, df, idf); stats: one row (n_docs, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str, buckets: int = 64) -> None:
        """Write the index as Parquet, postings clustered by term so that a query reads the row groups of its terms."""
        self.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseIndex:
        return SparseIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")))

    def add(self, docs: DataFrame) -> SparseIndex:
        """The index with further documents; frequencies and lengths are worked out again."""
        return from_postings(self.postings.unionByName(postings(docs)), self.stats.select("n_docs").join(_doc_count(docs)).select((F.col("n_docs") + F.col("n_new")).alias("n_docs")))


_COUNTED = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))


def _counted(words: Column) -> Column:
    """The distinct words of each list with their numbers."""

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            row = np.repeat(np.arange(len(b)), np.diff(b.offsets.to_numpy()))
            enc = b.flatten().dictionary_encode()
            v = max(len(enc.dictionary), 1)
            key, n = np.unique(row * v + enc.indices.to_numpy().astype(np.int64), return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(key // v, minlength=len(b))))).astype(np.int32)
            cells = pa.StructArray.from_arrays([enc.dictionary.take(pa.array(key % v)), pa.array(n.astype(np.int32))], names=["term", "tf"])
            yield pa.ListArray.from_arrays(pa.array(ends), cells).cast(_COUNTED)

    return count(words)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) of (doc_id, text), each doc_id once; dl is the document's number of tokens.

    A document's tokens are counted where it lies, in Arrow batches: no shuffle.
    """
    t = docs.where(F.col("text").isNotNull()).select("doc_id", bm25_tokens(F.col("text")).alias("w"))
    e = t.select("doc_id", F.size("w").alias("dl"), _counted(F.col("w")).alias("c")).select("doc_id", "dl", F.explode("c").alias("x"))
    return e.select("x.term", "doc_id", "x.tf", "dl")


def _doc_count(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).agg(F.count("*").alias("n_new"))


def from_postings(p: DataFrame, count: DataFrame) -> SparseIndex:
    """Index of postings and a one-row table with n_docs."""
    length = p.agg(F.sum("tf").alias("total"))
    stats = count.join(length).select("n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avgdl"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return SparseIndex(p, df.join(F.broadcast(stats.select("n_docs"))).select("term", "df", idf.alias("idf")), stats)


def build(docs: DataFrame) -> SparseIndex:
    """Index of (doc_id, text). Null texts are left out; an empty text counts as a document of no tokens."""
    return from_postings(postings(docs), _doc_count(docs).withColumnRenamed("n_new", "n_docs"))


def search(index: SparseIndex, queries: DataFrame, k: int = 10, keep: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score, rank): best ``k`` documents per (query_id, text), by BM25.

    A query's token counts as often as it occurs. ``keep`` (doc_id) restricts the documents before they
    are ranked. Only scores above 0 come out; ties go by doc_id. The queries' terms are joined to the
    postings, so documents without any of them are never scored; up to ``QUERY_TERMS`` of them are broadcast.
    """
    q = queries.where(F.col("text").isNotNull()).select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term"))
    q = q.groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(index.terms.select("term", "idf"), "term")
    p = index.postings.join(keep.select("doc_id").distinct(), "doc_id", "left_semi") if keep is not None else index.postings
    few = q.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS
    if few:
        met = p.join(F.broadcast(q), "term")
    else:
        parts = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        met = p.withColumn("part", F.pmod(F.hash("doc_id"), F.lit(SPREAD))).join(parts, ["term", "part"]).drop("part")
    s = met.join(F.broadcast(index.stats.select("avgdl")))
    w = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    r = s.groupBy("query_id", "doc_id").agg(F.sum(w).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return r.withColumn("rank", rank).where(F.col("rank") <= k)
