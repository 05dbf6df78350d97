"""The whole path: ingest, index, answer, evaluate."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.functions.text import clean_whitespace
from corpuslane.operators import benchmarks, chunking, deid, dense, embedding, generation, metrics, relations, retrieval, sections, sparse, verification
from corpuslane.session import materialize, release
from corpuslane.sources import files, pubmed


@dataclass(frozen=True)
class Settings:
    """Parameters of the path; :meth:`of` takes them from a nested dictionary as read from a settings file."""

    chunk_size: int = 512
    overlap: int = 64
    min_chunk_size: int = 50
    method: str = "sentence"
    provider: str = "hashing-64"
    query_provider: str = ""
    index_type: str = ""
    rrf_k: int = retrieval.RRF_K
    dense_weight: float = retrieval.DENSE_WEIGHT
    sparse_weight: float = retrieval.SPARSE_WEIGHT
    top_k: int = 10
    fetch: int = 50
    context_chunks: int = 8
    context_tokens: float = 3000.0
    least_confidence: float = 0.0

    @staticmethod
    def of(nested: dict) -> Settings:
        flat = {}
        for v in nested.values():
            if isinstance(v, dict):
                flat |= v
        names = {f.name for f in fields(Settings)}
        return Settings(**{k: v for k, v in (flat | nested).items() if k in names})


def ingest_articles(articles: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Chunks of articles with the metadata that filters use."""
    docs = pubmed.to_documents(articles)
    c = _chunks(docs, s)
    return c.join(docs.drop("text"), "doc_id")


def ingest_notes(notes: DataFrame, s: Settings = Settings(), categories: list[str] | None = None, by_section: bool = True) -> DataFrame:
    """Chunks of notes: cleaned, de-identified, white space tidied, segmented (discharge and physician notes), chunked."""
    d = deid.deidentify(sections.clean_notes(notes, categories), "text")
    d = d.select("row_id", "category", "chartdate", clean_whitespace(F.col("deidentified")).alias("text"))
    cut = F.trim("category").isin(*sections.SECTIONED) if by_section else F.lit(False)
    d = d.withColumn("sections", F.when(cut, sections.segment(F.col("text"))))
    docs = sections.note_documents(d)
    return _chunks(docs, s).join(docs.drop("text"), "doc_id")


def _chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """Chunks by the method that the settings name; an unknown name raises."""
    options = {"overlap": s.overlap}
    if s.method == "semantic":
        c = chunking.chunk(docs, "semantic", embedding.provider(s.provider), max_tokens=s.chunk_size, min_tokens=s.min_chunk_size, **options)
    elif s.method == "section":
        # a document is one section of its note or article; pieces are numbered through per document
        name = F.col("section") if "section" in docs.columns else F.lit("text")
        parts = docs.select("doc_id", F.lit(0).alias("ord"), F.coalesce(name, F.lit("text")).alias("section_name"), "text")
        c = chunking.chunk(parts, "section", chunk_size=s.chunk_size, min_chunk_size=s.min_chunk_size, **options).drop("ord", "section_name")
    else:
        return chunking.chunk(docs, s.method, chunk_size=s.chunk_size, min_chunk_size=s.min_chunk_size, **options)
    return c.withColumn("chunk_id", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def build_index(chunks: DataFrame, path: str, s: Settings = Settings(), cells: int | None = None) -> None:
    """Write a hybrid index of (chunk_id, text, ...): postings, vectors, chunks, manifest.

    Vectors lie in cells if ``s.index_type`` is ``ivf``, or if it is empty and there are more than 50 000.
    """
    spark = chunks.sparkSession
    c = materialize(chunks.withColumn("num", F.xxhash64("chunk_id")), "index-chunks")
    c.write.mode("overwrite").parquet(f"{path}/chunks")
    sparse.build(c.select(F.col("num").alias("doc_id"), "text")).save(f"{path}/sparse")
    model = embedding.provider(s.provider)
    v = c.select(F.col("num").alias("doc_id"), embedding.embed(F.col("text"), model).alias("vector"))
    n = c.count()
    kind = s.index_type or dense.choose_index(n)
    if kind == "ivf":
        v = materialize(v, "index-vectors")
        dense.build_ivf(v, cells).save(f"{path}/dense")
        release(v)
    elif kind == "flat":
        v.write.mode("overwrite").parquet(f"{path}/dense/rows")
    else:
        raise ValueError(f"unknown index type {kind!r}")
    files.write_manifest(spark, f"{path}/manifest", model_name=model.name, embedding_dim=model.dim, num_documents=n, index_type=kind, config=asdict(s))
    release(c)


def load_index(spark: SparkSession, path: str) -> retrieval.Retriever:
    """The retriever over an index written by :func:`build_index`: its kind of index, providers, weights and sizes come from the manifest."""
    m = files.read_manifest(spark, f"{path}/manifest")
    docs = spark.read.parquet(f"{path}/chunks").withColumn("doc_id", F.col("num"))
    if m["index_type"] == "ivf":
        vectors = dense.InvertedFile.load(spark, f"{path}/dense")
    else:
        vectors = spark.read.parquet(f"{path}/dense/rows").select("doc_id", "vector")
    return retrieval.Retriever.from_config(m["config"] | {"provider": m["model_name"]}, docs, sparse.SparseIndex.load(spark, f"{path}/sparse"), vectors)


def answer(r: retrieval.Retriever, queries: DataFrame, s: Settings = Settings(), task: str = "clinical_qa", conditions: dict | None = None, check: bool = False, reranking: bool = True) -> DataFrame:
    """(query_id, answer, confidence, citations, ...) of (query_id, text); with ``check`` the faithfulness, too."""
    hits = r.retrieve(queries, s.top_k, conditions, reranking=reranking)
    meta = [c for c in ("pmid", "title", "journal", "pub_date", "note_type", "section") if c in r.docs.columns]
    hits = hits.join(r.docs.select("doc_id", "text", *meta), "doc_id")
    chosen = materialize(generation.select_context(hits, s.context_chunks, s.context_tokens), "context")
    out = generation.generate(generation.format_context(chosen), queries, task, least_confidence=s.least_confidence)
    if not check:
        return out
    a = out.select(F.col("query_id").alias("answer_id"), F.col("answer").alias("text"))
    p = chosen.select(F.col("query_id").alias("answer_id"), F.col("rank").alias("passage_id"), "text")
    rep = verification.faithfulness(verification.verify(verification.claims(a), p), a)
    return out.join(rep.withColumnRenamed("answer_id", "query_id").drop("confidence"), "query_id")


def literature_review(r: retrieval.Retriever, queries: DataFrame, most: int = 20, first: int | None = None, last: int | None = None, s: Settings = Settings()) -> DataFrame:
    """Answers in the style of a review, over articles of a span of years, from the best ``most`` passages of each query."""
    cond = {k: v for k, v in (("pub_year_gte", first), ("pub_year_lte", last)) if v is not None}
    wide = Settings(**(asdict(s) | {"top_k": most, "fetch": max(most, s.fetch)}))
    return answer(r, queries, wide, "literature_synthesis", cond or None)


def adverse_events(r: retrieval.Retriever, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adverse reactions in the passages that answer the queries: (query_id, drug, event, n, confidence)."""
    hits = r.retrieve(queries, s.top_k).select("query_id", "doc_id").join(r.docs.select("doc_id", "text"), "doc_id")
    rel = relations.adverse_reactions(hits.select("doc_id", "text").dropDuplicates(["doc_id"]))
    j = hits.select("query_id", "doc_id").join(rel, "doc_id")
    return j.groupBy("query_id", F.lower("subject").alias("drug"), F.lower("object").alias("event")).agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def evaluate(r: retrieval.Retriever, qa: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of means over (query_id, question, answer, relevant_doc_ids): retrieval, overlap, faithfulness and answer scores."""
    q = qa.select("query_id", F.col("question").alias("text"))
    hits = materialize(r.retrieve(q, s.top_k), "evaluation-hits")
    truth = qa.select("query_id", F.explode("relevant_doc_ids").alias("source_id"))
    named = hits.join(r.docs.select("doc_id", F.col("source_doc" if "source_doc" in r.docs.columns else "chunk_id").alias("source_id"), "text"), "doc_id")
    top = metrics.retrieval_metrics(named.select("query_id", F.col("source_id").alias("doc_id"), "rank"), truth.withColumnRenamed("source_id", "doc_id"), (5,))
    out = answer(r, q, s, check=True)
    passages = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("passages"))
    j = qa.select("query_id", "question", F.col("answer").alias("truth")).join(out.select("query_id", "answer", "faithfulness"), "query_id").join(passages, "query_id", "left")
    sc = metrics.answer_scores(F.col("question"), F.col("answer"), F.coalesce("passages", F.array().cast("array<string>")), F.coalesce("truth", F.lit("")))
    m = j.select("faithfulness", sc.alias("s"), metrics.rouge_sets(F.col("answer"), F.coalesce("truth", F.lit(""))).alias("r"))
    return m.agg(F.avg("faithfulness").alias("faithfulness"), F.avg("s.relevance").alias("relevance"), F.avg("s.overall").alias("overall"), F.avg("r.rouge1").alias("rouge1"), F.count("*").alias("n")).join(
        top.select("precision", "recall", "ndcg", "mrr")
    )


def report(r: retrieval.Retriever, qa: DataFrame, s: Settings = Settings(), ks: tuple[int, ...] = (1, 5, 10), generate: bool = True, judge: embedding.Provider | None = None) -> DataFrame:
    """The full report as rows (group, metric, value) over (query_id, question, answer, relevant_doc_ids).

    Groups: ``retrieval@k`` (precision, recall, ndcg, mrr), and with ``generate`` also ``generation`` (bleu, stemmed
    rouge1, rouge2, rougeL and, with a ``judge`` embedder, bertscore_f1) and ``answers`` (faithfulness, relevance,
    context recall and precision, overall, verified faithfulness). Questions without a reference answer count
    in retrieval and faithfulness only.
    """
    q = qa.select("query_id", F.col("question").alias("text"))
    hits = materialize(r.retrieve(q, max(s.top_k, *ks)), "report-hits")
    named = hits.join(r.docs.select("doc_id", F.col("source_doc" if "source_doc" in r.docs.columns else "chunk_id").alias("source_id"), "text"), "doc_id")
    truth = qa.select("query_id", F.explode("relevant_doc_ids").alias("doc_id"))
    top = metrics.retrieval_metrics(named.select("query_id", F.col("source_id").alias("doc_id"), "rank"), truth, ks)
    names = ("precision", "recall", "ndcg", "mrr")
    out = top.select(F.concat(F.lit("retrieval@"), F.col("k").cast("string")).alias("group"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("group", "x.*")
    if not generate:
        return out
    made = materialize(answer(r, q, s, check=True).select("query_id", F.col("answer").alias("said"), F.col("faithfulness").alias("verified")), "report-answers")
    passages = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("passages"))
    j = qa.select("query_id", "question", F.col("answer").alias("truth")).join(made, "query_id").join(passages, "query_id", "left")
    with_truth = j.where("truth is not null")
    parts = {"rouge1": F.avg("r.rouge1"), "rouge2": F.avg("r.rouge2"), "rougeL": F.avg("r.rougeL")}
    scored = with_truth.withColumn("r", metrics.rouge(F.col("said"), F.col("truth")))
    if judge is not None:
        scored = scored.withColumn("b", metrics.embedding_score(F.col("said"), F.col("truth"), judge))
        parts["bertscore_f1"] = F.avg("b.f1")
    generation_row = scored.agg(*[c.alias(n) for n, c in parts.items()]).join(metrics.bleu(with_truth.select(F.col("query_id").alias("id"), F.col("said").alias("hypothesis"), F.col("truth").alias("reference"))).select("bleu"))
    sc = metrics.answer_scores(F.col("question"), F.col("said"), F.coalesce("passages", F.array().cast("array<string>")), F.coalesce("truth", F.lit("")))
    five = ("faithfulness", "relevance", "context_recall", "context_precision", "overall")
    answers_row = j.select("verified", sc.alias("s")).agg(*[F.avg(f"s.{c}").alias(c) for c in five], F.avg("verified").alias("verified_faithfulness"))
    for group, row in (("generation", generation_row), ("answers", answers_row)):
        cols = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
        out = out.unionByName(row.select(F.lit(group).alias("group"), F.explode(F.array(*cols)).alias("x")).select("group", "x.*"))
    return out


def benchmark(name: str, rows: DataFrame) -> DataFrame:
    """Scores of predictions by the name of a benchmark: bioasq (type, predicted, gold), pubmedqa and medqa (predicted, gold), i2b2 (side ``predicted`` or ``gold``, doc_id, text, type)."""
    if name == "bioasq":
        return benchmarks.bioasq(rows)
    if name == "pubmedqa":
        return benchmarks.label_accuracy(rows.select("gold", benchmarks.answer_label(F.col("predicted")).alias("predicted")))
    if name == "medqa":
        return benchmarks.choice_accuracy(rows)
    if name == "i2b2":
        cols = ("doc_id", "text", "type")
        return benchmarks.entity_prf(rows.where("side = 'predicted'").select(*cols), rows.where("side = 'gold'").select(*cols))
    raise ValueError(f"unknown benchmark {name!r}")


__all__ = ["Settings", "adverse_events", "answer", "benchmark", "benchmarks", "build_index", "evaluate", "ingest_articles", "ingest_notes", "literature_review", "load_index", "report"]
