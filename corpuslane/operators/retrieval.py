"""Query expansion, rank fusion, re-ranking and the retrieval plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import word_set
from corpuslane.operators import dense, embedding, sparse

# Synonyms by term, in the order in which terms are looked for.
SYNONYMS: dict[str, tuple[str, ...]] = {
    "heart attack": ("myocardial infarction", "MI", "acute MI", "STEMI", "NSTEMI"),
    "myocardial infarction": ("heart attack", "MI", "acute MI", "cardiac infarction"),
    "stroke": ("cerebrovascular accident", "CVA", "cerebral infarction", "brain attack"),
    "cancer": ("malignancy", "neoplasm", "tumor", "carcinoma"),
    "diabetes": ("diabetes mellitus", "DM", "type 2 diabetes", "T2DM", "hyperglycemia"),
    "hypertension": ("high blood pressure", "HTN", "elevated blood pressure"),
    "blood pressure": ("BP", "hypertension", "hypotension"),
    "drug interaction": ("DDI", "drug-drug interaction", "pharmacokinetic interaction"),
    "adverse event": ("adverse drug reaction", "ADR", "side effect", "drug toxicity"),
    "chest pain": ("angina", "angina pectoris", "thoracic pain", "precordial pain"),
    "shortness of breath": ("dyspnea", "breathlessness", "respiratory distress"),
    "kidney disease": ("renal disease", "nephropathy", "chronic kidney disease", "CKD"),
    "alzheimer": ("alzheimer's disease", "AD", "dementia", "cognitive decline"),
    "covid": ("COVID-19", "SARS-CoV-2", "coronavirus disease", "coronavirus"),
    "mri": ("magnetic resonance imaging", "MRI scan", "NMR imaging"),
    "ct scan": ("computed tomography", "CT", "CAT scan", "computerized tomography"),
}


def expand(query: Column, synonyms: dict[str, tuple[str, ...]] | None = None, most: int = 5) -> Column:
    """The query with up to ``most`` synonyms added, in table order, of terms that occur anywhere in it.

    Of each term the first ``most`` synonyms count, less those whose letters are in the query already.
    """
    low = F.lower(query)
    lists = []
    for term, words in (SYNONYMS if synonyms is None else synonyms).items():
        own = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(w.lower()).alias("l")) for w in words[:most]])
        fresh = F.transform(F.filter(own, lambda x: ~F.contains(low, x["l"])), lambda x: x["w"])
        lists.append(F.when(F.contains(low, F.lit(term)), fresh).otherwise(F.array().cast("array<string>")))
    extra = F.slice(F.flatten(F.array(*lists)), 1, most)
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.7, 0.3


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = 50, rrf_k: int = RRF_K, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """Reciprocal rank fusion of two (query_id, doc_id, rank) tables: (query_id, doc_id, score, dense_rank, sparse_rank, rank, method).

    score = sum of weight / (rrf_k + rank) over the sides that hold the document. Ties go to the better
    dense rank, then the better sparse rank, then the doc_id.
    """
    d = dense_hits.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    s = sparse_hits.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    j = d.join(s, ["query_id", "doc_id"], "full_outer")

    def part(rank: str, weight: float) -> Column:
        return F.coalesce(F.lit(weight) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))

    j = j.withColumn("score", part("dense_rank", dense_weight) + part("sparse_rank", sparse_weight))
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("score", 12)), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "doc_id"
    )
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("method", F.lit("hybrid_rrf"))


def lexical_score(query: Column, text: Column) -> Column:
    """Default re-ranking score: F1 of the two sets of words; 0 if they share none."""
    q, t = word_set(query), word_set(text)
    both = F.size(F.array_intersect(q, t))
    return F.when(both > 0, 2.0 * both / (F.size(q) + F.size(t))).otherwise(0.0)


def cross_encoder(model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32):
    """A scorer for :func:`rerank` around a model that scores lists of (query, text) pairs, ``batch`` pairs at a time.

    ``model`` is pickled to the workers once per task and kept there over Arrow batches. Nulls count as empty.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for q, t in batches:
            pairs = [(a or "", b or "") for a, b in zip(q.to_pylist(), t.to_pylist(), strict=True)]
            yield pa.array([float(x) for k in range(0, len(pairs), batch) for x in model(pairs[k : k + batch])], pa.float64())

    return score


def telemetry(hits: DataFrame, name: str = "retrieval") -> tuple[DataFrame, Observation]:
    """``hits`` with counters that are filled by the first action on them: rows, queries (approximate), best and mean score."""
    seen = Observation(name)
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    counts = (F.count("*").alias("rows"), F.approx_count_distinct("query_id").alias("queries"), F.max(score).alias("best_score"), F.avg(score).alias("mean_score"))
    return hits.observe(seen, *counts), seen


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10, scorer=lexical_score) -> DataFrame:
    """The ``k`` hits per query of the highest ``scorer(query text, document text)``; ties keep the order they had.

    ``scorer`` is a function of two columns, e.g. an Arrow UDF around a cross-encoder. Only the hits'
    texts are fetched.
    """
    j = hits.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(docs.select("doc_id", F.col("text").alias("_d")), "doc_id")
    j = j.withColumn("rerank_score", scorer(F.col("_q"), F.col("_d")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank"))
    out = j.withColumn("new_rank", rank).where(F.col("new_rank") <= k).drop("_q", "_d", "rank").withColumnRenamed("new_rank", "rank")
    return out.withColumn("method", F.concat(F.coalesce("method", F.lit("hybrid")), F.lit("+reranked"))) if "method" in hits.columns else out


@dataclass
class Retriever:
    """Hybrid retrieval for whole tables of queries.

    ``docs``: (doc_id, text, and columns that filters name); ``vectors``: (doc_id bigint, vector), searched
    exactly, or an inverted file. ``query_provider`` embeds the queries if it is not the documents' provider.
    ``concepts``, a function of the query column, adds terms of an outside source to the expansion.
    """

    docs: DataFrame
    index: sparse.SparseIndex
    vectors: DataFrame | dense.InvertedFile
    provider: embedding.Provider = field(default_factory=embedding.HashingProvider)
    fetch: int = 50
    multiplier: int = 3
    query_provider: embedding.Provider | None = None
    rrf_k: int = RRF_K
    dense_weight: float = DENSE_WEIGHT
    sparse_weight: float = SPARSE_WEIGHT
    concepts: Callable[[Column], Column] | None = None

    @staticmethod
    def from_config(config: dict, docs: DataFrame, index: sparse.SparseIndex, vectors: DataFrame | dense.InvertedFile) -> Retriever:
        """A retriever whose settings come from a (nested) dictionary; names that it does not know are ignored."""
        flat = {k: v for part in config.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in config.items() if not isinstance(v, dict)}
        own = {k: flat[k] for k in ("fetch", "multiplier", "rrf_k", "dense_weight", "sparse_weight") if k in flat}
        for slot, name in (("provider", "provider"), ("query_provider", "query_provider")):
            if flat.get(name):
                own[slot] = embedding.provider(flat[name])
        return Retriever(docs, index, vectors, **own)

    def _dense(self, q: DataFrame, wide: int, keep: DataFrame | None) -> DataFrame:
        v = self.vectors
        if not isinstance(v, dense.InvertedFile):
            return dense.flat_search(v.join(keep, "doc_id", "left_semi") if keep is not None else v, q, wide)
        return dense.ivf_search(replace(v, rows=v.rows.join(keep, "doc_id", "left_semi")) if keep is not None else v, q, wide)

    def retrieve(self, queries: DataFrame, k: int = 10, conditions: dict | None = None, expansion: bool = True, reranking: bool = True, mode: str = "hybrid") -> DataFrame:
        """Best ``k`` documents per (query_id, text): filter, expand, search both sides, fuse, re-rank.

        BM25 sees the expanded query; the embedder and the re-ranker see the original one. ``mode`` is
        ``hybrid``, ``dense`` or ``sparse``.
        """
        keep = self.docs.where(dense.metadata_filter(conditions)).select("doc_id") if conditions else None
        wide = self.fetch * self.multiplier
        q = queries.where("text is not null")
        if mode != "dense":
            text = expand(F.col("text")) if expansion else F.col("text")
            if expansion and self.concepts is not None:
                text = F.concat_ws(" ", text, self.concepts(F.col("text")))
            s = sparse.search(self.index, q.select("query_id", text.alias("text")), wide, keep)
        if mode != "sparse":
            d = self._dense(q.select("query_id", embedding.embed(F.col("text"), self.query_provider or self.provider).alias("vector")), wide, keep)
        if mode == "hybrid":
            hits = fuse(d, s, self.fetch, self.rrf_k, self.dense_weight, self.sparse_weight)
        else:
            hits = (d if mode == "dense" else s).where(F.col("rank") <= self.fetch).withColumn("method", F.lit(mode))
        if reranking:
            return rerank(hits, q, self.docs, k)
        return hits.where(F.col("rank") <= k)
