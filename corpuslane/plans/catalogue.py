"""All queries over the core operators, with their SQL where SQL can express them (DuckDB dialect).

Queries run over whole tables. Where a search takes queries from a table, these are the rows whose id is
divisible by 20, against all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslane.functions import text as tx
from corpuslane.operators import benchmarks, chunking, deid, dense, embedding, generation, metrics, ner, relations, retrieval, sections, sparse, tables, verification
from corpuslane.plans import sql, sql_text
from corpuslane.session import materialize, scratch_root, spread, table
from corpuslane.sources import files, pubmed
from corpuslane.streaming import audit

QUERIES: dict = {}
SQL: dict = {}
FLAGSHIP = "rrf_hybrid"


def query(sql_text: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql_text is not None:
            SQL[f.__name__] = sql_text
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text"))


def _notes(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return spread(table(s, d, "clinical_notes").select(*cols))


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def r6(c: str):
    return F.round(c, 6).alias(c)


# text ---------------------------------------------------------------------------------------------


@query("select doc_id, len(regexp_extract_all(text, '\\S+'))::int as n_words, floor(len(regexp_extract_all(text, '\\S+')) * 1.3::double)::int as token_count from documents")
def token_count(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.word_count(F.col("text")).alias("n_words"), tx.token_estimate(F.col("text")).alias("token_count"))


@query(sql.SENTENCES_PLAIN)
def sentences_plain(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.posexplode(tx.sentences_plain(F.col("text"))).alias("pos", "sentence"))


@query(sql.SENTENCES_BIOMEDICAL)
def sentences_biomedical(s: SparkSession, d: str) -> DataFrame:
    n = _notes(s, d, "row_id", "text")
    return n.select("row_id", F.posexplode(tx.sentences_biomedical(F.col("text"))).alias("pos", "sentence"))


@query(sql.CLEAN_WHITESPACE)
def clean_whitespace(s: SparkSession, d: str) -> DataFrame:
    t = tx.clean_whitespace(F.col("text"))
    return _notes(s, d, "row_id", "text").select("row_id", F.md5(t).alias("hash"), F.length(t).alias("n_chars"))


# de-identification --------------------------------------------------------------------------------


@query(sql.DEID_TEXT)
def deid_text(s: SparkSession, d: str) -> DataFrame:
    r = deid.deidentify(_notes(s, d, "row_id", "text"), "text")
    plain = F.regexp_replace(F.regexp_replace("deidentified", r"[^\x00-\x7F\p{L}\p{N}]", "~"), r"[^\x00-\x7F]", "_")
    return r.select("row_id", F.md5(plain).alias("hash"), "phi_count")


@query(sql.DEID_AUDIT)
def deid_audit_by_type(s: SparkSession, d: str) -> DataFrame:
    return deid.audit(_notes(s, d, "text"), "text")


@query(sql.PHI_RESIDUAL)
def phi_residual(s: SparkSession, d: str) -> DataFrame:
    """Sections in which identifiers are left."""
    return spread(table(s, d, "note_sections").select("section_id", "text")).select("section_id", F.coalesce(deid.contains_phi(F.col("text")), F.lit(False)).alias("has_phi"))


# notes --------------------------------------------------------------------------------------------


@query("select case when coalesce(iserror, '') = '1' then true else false end as is_error, count(*) as n, count(distinct trim(category)) as categories from clinical_notes group by 1")
def note_errors(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "clinical_notes")
    return n.groupBy((F.coalesce("iserror", F.lit("")) == "1").alias("is_error")).agg(F.count("*").alias("n"), F.countDistinct(F.trim("category")).alias("categories"))


@query("""select count(*) as total, count(*) filter (coalesce(iserror, '') = '1') as errors,
  count(*) filter (coalesce(iserror, '') <> '1' and coalesce(trim(text), '') = '') as empty,
  count(*) filter (coalesce(iserror, '') <> '1' and coalesce(trim(text), '') <> '') as kept from clinical_notes""")
def note_counters(s: SparkSession, d: str) -> DataFrame:
    return files.note_counters(table(s, d, "clinical_notes"))


@query(sql.NOTE_TYPES)
def note_types(s: SparkSession, d: str) -> DataFrame:
    n = sections.clean_notes(table(s, d, "clinical_notes"))
    return n.select("row_id", sections.note_type(F.trim("category")).alias("note_type"), F.year("chartdate").alias("year"))


@query(sql_text.NOTE_SEGMENTS)
def note_segments(s: SparkSession, d: str) -> DataFrame:
    n = sections.clean_notes(_notes(s, d, "row_id", "category", "iserror", "text"), list(sections.SECTIONED))
    e = n.select("row_id", F.posexplode(sections.segment(F.col("text"))).alias("ord", "s"))
    return e.select("row_id", "ord", "s.section_name", "s.start_char", "s.end_char", F.md5("s.text").alias("hash"))


@query(sql_text.RADIOLOGY)
def radiology_parse(s: SparkSession, d: str) -> DataFrame:
    n = sections.clean_notes(_notes(s, d, "row_id", "category", "iserror", "text"), ["Radiology"]).withColumn("s", sections.radiology_sections(F.col("text")))
    return n.select("row_id", F.size("s").alias("n_sections"), F.length(sections.radiology_impression(F.col("s"))).alias("impression_chars"))


@query(sql_text.NOTE_DOCUMENTS)
def note_documents(s: SparkSession, d: str) -> DataFrame:
    n = sections.clean_notes(_notes(s, d, "row_id", "category", "iserror", "text"))
    n = n.withColumn("sections", F.when(F.trim("category").isin(*sections.SECTIONED), sections.segment(F.col("text"))))
    return sections.note_documents(n).select("doc_id", "row_id", "section", "note_type", F.md5("text").alias("hash"))


# chunks -------------------------------------------------------------------------------------------


@query(sql_text.CHUNKS_SENTENCE)
def chunks_sentence(s: SparkSession, d: str) -> DataFrame:
    c = chunking.sentence_chunks(_docs(s, d), 128, 24, 10)
    return c.select("chunk_id", "doc_id", "chunk_index", "token_count", "char_start", "char_end", F.md5("text").alias("hash"))


@query(sql_text.CHUNKS_SEMANTIC)
def chunks_semantic(s: SparkSession, d: str) -> DataFrame:
    model = embedding.HashingProvider(16, False, "hashing-16")
    c = chunking.semantic_chunks(_docs(s, d), model, 85.0, 128, 10, 24)
    return c.select("doc_id", "chunk_index", "token_count", F.md5("text").alias("hash"))


@query(sql_text.CHUNKS_SECTION)
def chunks_section(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "note_sections").select(F.col("note_row_id").alias("doc_id"), F.col("section_id").alias("ord"), F.coalesce("section_name", F.lit("")).alias("section_name"), "text")
    c = chunking.section_chunks(n, 64, 16, 10)
    return c.select("doc_id", "ord", "section_name", "chunk_index", "token_count", F.md5("text").alias("hash"))


@query(sql.BREAKPOINTS)
def semantic_breakpoints(s: SparkSession, d: str) -> DataFrame:
    b = chunking.breakpoints(table(s, d, "embeddings"), "label", "vec_id", "embedding")
    return b.select("vec_id", "label", r6("sim"), "is_break")


# embeddings and dense search ----------------------------------------------------------------------


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, len(embedding)::int as dim from embeddings")
def vector_norms(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.round(embedding.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dim"))


@query("""select vec_id, round(list_dot_product(u, u), 6) as squared from (select vec_id, list_transform(embedding::double[], lambda x:
  x / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-8)) as u from embeddings)""")
def l2_normalise(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "embeddings").select("vec_id", embedding.l2_normalise(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(embedding.dot(F.col("u"), F.col("u")), 6).alias("squared"))


@query("""select section_id, c.key is not null as hit from (select section_id, md5('hashing-64::' || text) as key from note_sections where text is not null) s
  left join (select distinct md5('hashing-64::' || text) as key from chunks) c on c.key = s.key""")
def embed_cache_hits(s: SparkSession, d: str) -> DataFrame:
    """Which sections are embedded already if the cache holds all chunks."""
    cache = table(s, d, "chunks").select(F.lit("hashing-64").alias("model"), embedding.cache_key("hashing-64", F.col("text")).alias("key"), F.lit(None).cast("array<float>").alias("vector")).distinct()
    t = table(s, d, "note_sections").where("text is not null").select("section_id", "text")
    hits, _ = embedding.cache_split(t, cache, "hashing-64")
    return t.select("section_id").join(hits.select("section_id", F.lit(True).alias("h")), "section_id", "left").select("section_id", F.coalesce("h", F.lit(False)).alias("hit"))


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(sql.DENSE.format(where="true"))
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return dense.flat_search(*_vectors(s, d), k=10)


@query(sql.DENSE.format(where="v.label in (1, 2, 3, 5, 8) and v.label >= 2"))
def dense_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(s, d)
    return dense.flat_search(v.where(dense.metadata_filter({"label": [1, 2, 3, 5, 8], "label_gte": 2})), q, k=10)


@query()
def ivf_topk(s: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(s, d)
    return dense.ivf_search(dense.build_ivf(v), q, 10)


@query()
def ivf_recall(s: SparkSession, d: str) -> DataFrame:
    """Recall of the inverted file against exact search; at least 0.9."""
    v, q = _vectors(s, d)
    r = dense.recall(dense.ivf_search(dense.build_ivf(v), q, 10), dense.flat_search(v, q, k=10))
    return r.select(r6("recall"), "hits")


@query("select true as enough, (select count(*) from embeddings where vec_id % 20 = 0) * 10 as hits")
def ivf_enough(s: SparkSession, d: str) -> DataFrame:
    """Whether the inverted file finds at least 0.9 of the hits of exact search."""
    return ivf_recall(s, d).select((F.col("recall") >= 0.9).alias("enough"), "hits")


def _lsh(s: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(s, d)
    return dense.lsh_search(v, q, dense.Hyperplanes(64, tables=8, bits=dense.bits_for(v.count())), 10)


@query()
def lsh_topk(s: SparkSession, d: str) -> DataFrame:
    return _lsh(s, d)


@query("select true as enough, (select count(*) from embeddings where vec_id % 20 = 0) * 10 as hits")
def lsh_enough(s: SparkSession, d: str) -> DataFrame:
    """Whether hyperplane hashing finds at least 0.9 of the hits of exact search."""
    r = dense.recall(_lsh(s, d), dense.flat_search(*_vectors(s, d), k=10, unit=True))
    return r.select((F.col("recall") >= 0.9).alias("enough"), "hits")


@query(sql_text.COMPARE)
def compare_embedders(s: SparkSession, d: str) -> DataFrame:
    """Which of two providers brings a question nearest to its own passage."""
    e = table(s, d, "eval_items")
    out = None
    for dim in (16, 64):
        m = embedding.HashingProvider(dim, False, f"hashing-{dim}")
        v = e.select(F.col("item_id").alias("doc_id"), embedding.embed(F.col("passage"), m).alias("vector"))
        q = e.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), embedding.embed(F.col("question"), m).alias("vector"))
        h = dense.flat_search(v, q, k=e.count(), unit=True).select(F.lit(m.name).alias("provider"), "query_id", "doc_id", (F.col("query_id") == F.col("doc_id")).alias("right"), "score")
        out = h if out is None else out.unionByName(h)
    return embedding.compare_providers(out).select("provider", r6("mrr"), r6("avg_sim"))


# sparse and hybrid search -------------------------------------------------------------------------


@query(sql.BM25_STATS)
def bm25_stats(s: SparkSession, d: str) -> DataFrame:
    return sparse.build(_docs(s, d)).terms.select("term", "df", r6("idf"))


def _index(s: SparkSession, d: str) -> sparse.SparseIndex:
    """The documents' index with its postings written once."""
    docs = _docs(s, d)
    count = docs.where("text is not null").agg(F.count("*").alias("n_docs"))
    return sparse.from_postings(materialize(sparse.postings(docs), "postings"), count)


@query(sql.bm25("true"))
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return sparse.search(_index(s, d), _questions(s, d), 10).select("query_id", "doc_id", r6("score"), "rank")


@query(sql.bm25("lang = 'en'"))
def bm25_filtered(s: SparkSession, d: str) -> DataFrame:
    keep = table(s, d, "documents").where(dense.metadata_filter({"lang": "en"})).select("doc_id")
    return sparse.search(_index(s, d), _questions(s, d), 10, keep).select("query_id", "doc_id", r6("score"), "rank")


_MODEL = embedding.HashingProvider(16, False, "hashing-16")


def _dense_hits(s: SparkSession, d: str, k: int) -> DataFrame:
    v = _docs(s, d).select("doc_id", embedding.embed(F.col("text"), _MODEL).alias("vector"))
    q = _questions(s, d).select("query_id", embedding.embed(F.col("text"), _MODEL).alias("vector"))
    return dense.flat_search(v, q, k, unit=True)


@query(sql.HASHED_SEARCH)
def dense_hashed(s: SparkSession, d: str) -> DataFrame:
    return _dense_hits(s, d, 30).select("query_id", "doc_id", r6("score"), "rank")


def _fused(s: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(_dense_hits(s, d, 30), sparse.search(_index(s, d), _questions(s, d), 30), 10)


@query(sql.RRF)
def rrf_hybrid(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(sql.RERANK)
def rerank_lexical(s: SparkSession, d: str) -> DataFrame:
    r = retrieval.rerank(_fused(s, d), _questions(s, d), _docs(s, d), 5)
    return r.select("query_id", "doc_id", F.round("rerank_score", 6).alias("score"), "rank")


@query(sql.expansion())
def query_expansion(s: SparkSession, d: str) -> DataFrame:
    q = F.concat_ws(" ", F.col("question"), F.when(F.col("item_id") % 2 == 0, "after stroke or heart attack").otherwise("with diabetes on MRI"))
    return table(s, d, "eval_items").select("item_id", retrieval.expand(q).alias("expanded"))


@query(sql_text.RETRIEVE)
def hybrid_retrieve(s: SparkSession, d: str) -> DataFrame:
    """The whole retrieval plan over documents, English only."""
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    v = docs.select("doc_id", embedding.embed(F.col("text"), _MODEL).alias("vector"))
    r = retrieval.Retriever(docs, _index(s, d), v, _MODEL).retrieve(_questions(s, d), 10, {"lang": "en"})
    return r.select("query_id", "doc_id", r6("rerank_score"), "rank", "method")


@query(sql_text.CONTRASTIVE)
def contrastive_pairs(s: SparkSession, d: str) -> DataFrame:
    """Training pairs of questions and the abstracts they name, with the best-ranked other abstract as hard negative."""
    e = table(s, d, "eval_items").where("item_id % 20 = 0")
    p = table(s, d, "pubmed_abstracts").where("pmid is not null").groupBy("pmid").agg(F.max_by("abstract", "rec_id").alias("text"), F.max("rec_id").alias("doc_id"))
    docs = p.where("text is not null and text != ''")
    names = docs.select(F.concat(F.lit("pmid_"), "pmid").alias("name"), "doc_id")
    truth = e.select(F.col("item_id").alias("query_id"), F.explode("relevant_doc_ids").alias("name")).join(names, "name").select("query_id", "doc_id")
    q = e.select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    v = docs.select("doc_id", embedding.embed(F.col("text"), _MODEL).alias("vector"))
    hits = dense.flat_search(v, q.select("query_id", embedding.embed(F.col("text"), _MODEL).alias("vector")), 30)
    c = embedding.contrastive_pairs(q, docs.select("doc_id", "text"), truth, hits)
    return c.select(*[F.md5(x).alias(x) for x in ("query", "positive", "negative")])


# metrics ------------------------------------------------------------------------------------------


@query(sql.RETRIEVAL_METRICS)
def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    """Search among labelled vectors; those of the query's label are relevant."""
    v, q = _vectors(s, d)
    lab = table(s, d, "embeddings").select("vec_id", "label")
    truth = lab.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id").join(lab.withColumnRenamed("vec_id", "doc_id"), "label").select("query_id", "doc_id")
    m = metrics.retrieval_metrics(dense.flat_search(v, q, k=10), truth)
    return m.select("k", r6("precision"), r6("recall"), r6("ndcg"), r6("mrr"), "n_queries")


@query(sql.BLEU)
def bleu_corpus(s: SparkSession, d: str) -> DataFrame:
    p = spread(table(s, d, "pubmed_abstracts").select(F.col("rec_id").alias("id"), F.col("title").alias("hypothesis"), F.col("abstract").alias("reference")))
    return metrics.bleu(p).select(F.round("bleu", 9).alias("bleu"), "n")


@query(sql.ROUGE)
def rouge_sets(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pubmed_abstracts").where("title is not null and abstract is not null").select("rec_id", metrics.rouge_sets(F.col("title"), F.col("abstract")).alias("r"))
    return p.select("rec_id", F.round("r.rouge1", 6).alias("rouge1"), F.round("r.rougeL", 6).alias("rougeL"))


@query(sql_text.ROUGE_PLAIN)
def rouge_ngrams(s: SparkSession, d: str) -> DataFrame:
    """Clipped n-gram scores without stemming."""
    p = table(s, d, "pubmed_abstracts").where("title is not null and abstract is not null").select("rec_id", metrics.rouge(F.col("title"), F.col("abstract"), stemmed=False).alias("r"))
    return p.select("rec_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("rouge1", "rouge2")])


@query(sql_text.EMBEDDING_SCORE)
def embedding_scores(s: SparkSession, d: str) -> DataFrame:
    """Titles against abstracts by their words' best matches; with one coordinate per word a match is an equal coordinate and sign."""
    p = table(s, d, "pubmed_abstracts").where("title is not null and abstract is not null")
    r = p.select("rec_id", metrics.embedding_score(F.regexp_replace("title", r"[^\x00-\x7F]", " "), F.regexp_replace("abstract", r"[^\x00-\x7F]", " "), _MODEL).alias("r"))
    return r.select("rec_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def rouge_full(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pubmed_abstracts").where("title is not null and abstract is not null").select("rec_id", metrics.rouge(F.col("title"), F.col("abstract")).alias("r"))
    return p.select("rec_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """(item_id, passage_id, text): the abstracts that an item names; of an article harvested twice the later row."""
    e = table(s, d, "eval_items").select("item_id", F.explode("relevant_doc_ids").alias("name"))
    p = table(s, d, "pubmed_abstracts").where("pmid is not null").groupBy("pmid").agg(F.max_by("abstract", "rec_id").alias("text"), F.max("rec_id").alias("passage_id"))
    return e.distinct().join(p.select(F.concat(F.lit("pmid_"), "pmid").alias("name"), "passage_id", "text"), "name").where("text is not null").select("item_id", "passage_id", "text")


@query(sql.ANSWER_SCORES)
def answer_scores(s: SparkSession, d: str) -> DataFrame:
    p = _evidence(s, d).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "text"))), lambda x: x["text"]).alias("p"))
    e = table(s, d, "eval_items").join(p, "item_id")
    sc = metrics.answer_scores(F.col("question"), F.col("passage"), F.col("p"), F.coalesce("answer", F.lit("")))
    return e.select("item_id", sc.alias("s")).select("item_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("faithfulness", "relevance", "context_recall", "context_precision", "overall")])


# context and verification -------------------------------------------------------------------------


def _context(s: SparkSession, d: str) -> DataFrame:
    hits = sparse.search(_index(s, d), _questions(s, d), 10).join(_docs(s, d), "doc_id")
    return generation.select_context(hits, 8, 1200.0)


@query(sql.CONTEXT_SELECT)
def context_select(s: SparkSession, d: str) -> DataFrame:
    return _context(s, d).select("query_id", "doc_id", "rank", r6("cum_tokens"))


@query(sql.CONTEXT_FORMAT)
def context_format(s: SparkSession, d: str) -> DataFrame:
    return generation.format_context(_context(s, d)).select("query_id", F.md5("context").alias("hash"), "n_citations")


@query(sql_text.ANSWERS)
def answers(s: SparkSession, d: str) -> DataFrame:
    g = generation.generate(generation.format_context(_context(s, d)), _questions(s, d))
    return g.select("query_id", F.md5("answer").alias("hash"), "confidence", "n_citations")



@query("""select item_id, case when t like '%confidence level: high%' or t like '%high confidence%' then 0.85 when t like '%confidence level: medium%' or t like '%moderate confidence%' then 0.6
  when t like '%confidence level: low%' or t like '%low confidence%' then 0.35 when t like '%insufficient evidence%' or t like '%cannot answer%' or t like '%not enough information%' or t like '%context does not contain%' then 0.1
  else 0.7 end::double as confidence from (select item_id, lower(passage || case item_id % 5 when 0 then ' Confidence level: High' when 1 then ' moderate confidence' when 2 then ' Low confidence.' when 3 then ' There is insufficient evidence' else '' end) as t from eval_items)""")
def confidence_parse(s: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id") % 5
    said = F.when(k == 0, " Confidence level: High").when(k == 1, " moderate confidence").when(k == 2, " Low confidence.").when(k == 3, " There is insufficient evidence").otherwise("")
    return table(s, d, "eval_items").select("item_id", generation.confidence(F.concat("passage", said)).alias("confidence"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select(F.col("item_id").alias("answer_id"), F.col("passage").alias("text"))


@query(sql.CLAIMS)
def claims_heuristic(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "pubmed_abstracts").select(F.col("rec_id").alias("answer_id"), F.col("abstract").alias("text"))
    return verification.claims(a)


@query("""select rec_id, (row_number() over (partition by rec_id order by i) - 1)::int as pos, k as claim from (select rec_id, unnest(keywords[:20]) as k, unnest(range(least(20, len(keywords)))) as i from pubmed_abstracts)
  where trim(k) <> ''""")
def claims_json(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("The claims are "), F.to_json("keywords"), F.lit(" as asked."))
    return table(s, d, "pubmed_abstracts").select("rec_id", F.posexplode(verification.claims_from_json(t)).alias("pos", "claim"))


@query(sql_text.CLAIM_REPLIES)
def claims_replies(s: SparkSession, d: str) -> DataFrame:
    """Claims that a model listed, for every second answer; the others' replies hold no list."""
    a = _answers(s, d)
    reply = F.when(F.col("answer_id") % 2 == 0, F.concat(F.lit("Claims: "), F.to_json(F.array(F.col("text"), F.lit("second claim"))))).otherwise("I cannot list them.")
    return verification.claims_from_replies(a.where("text is not null").withColumn("reply", reply))


def _verified(s: SparkSession, d: str) -> DataFrame:
    p = _evidence(s, d).withColumnRenamed("item_id", "answer_id")
    return verification.verify(verification.claims(_answers(s, d)), p)


@query(sql.FAITHFULNESS)
def faithfulness(s: SparkSession, d: str) -> DataFrame:
    r = verification.faithfulness(_verified(s, d), _answers(s, d))
    return r.select("answer_id", "claims", "supported", "contradicted", "neutral", r6("faithfulness"))


@query(sql_text.CLAIM_LABELS)
def claim_labels(s: SparkSession, d: str) -> DataFrame:
    return _verified(s, d).select("answer_id", "claim_id", "label", r6("score"), "passage_id")


@query(sql_text.CITATIONS)
def citation_accuracy(s: SparkSession, d: str) -> DataFrame:
    ev = _evidence(s, d).withColumnRenamed("item_id", "answer_id")
    n = F.row_number().over(Window.partitionBy("answer_id").orderBy("passage_id"))
    a = _answers(s, d).withColumn("text", F.concat("text", F.lit(" [Doc 1] [Doc 2] [Doc 9]")))
    r = verification.citation_accuracy(a, ev.withColumn("n", n), _verified(s, d))
    return r.select("answer_id", "citations", "supported", r6("accuracy"))


@query(sql_text.CONSISTENCY)
def self_consistency(s: SparkSession, d: str) -> DataFrame:
    ev = _evidence(s, d).select(F.col("item_id").alias("answer_id"), F.col("passage_id").alias("sample_id"), "text")
    r = verification.self_consistency(verification.claims(_answers(s, d)), ev, threshold=0.3)
    return r.select("answer_id", "claims", "consistent", r6("score"))


# entities and relations ---------------------------------------------------------------------------


def _entities(s: SparkSession, d: str) -> DataFrame:
    terms = table(s, d, "pubmed_abstracts").select(F.explode("mesh_terms").alias("x"))
    term = F.trim(F.replace(F.split_part("x", F.lit("/"), F.lit(1)), F.lit("*"), F.lit("")))
    kind = F.when(F.lower(term).rlike("(?:in|ine|ab|ib|ex|tin)$"), "DRUG").when(F.lower(term).rlike("protein$"), "PROTEIN").otherwise("DISEASE")
    return ner.gazetteer(spread(table(s, d, "chunks").select(F.col("chunk_id").alias("doc_id"), "text")), terms.select(term.alias("term"), kind.alias("type")))


@query(sql_text.NER)
def ner_gazetteer(s: SparkSession, d: str) -> DataFrame:
    return _entities(s, d)


@query(sql_text.NER_OVERLAP)
def ner_overlap(s: SparkSession, d: str) -> DataFrame:
    return ner.ensemble([_entities(s, d)])


@query(sql_text.NER_STRUCTURED)
def ner_structured(s: SparkSession, d: str) -> DataFrame:
    return ner.by_type(_entities(s, d))


@query(sql_text.NER_COUNTS)
def ner_counts(s: SparkSession, d: str) -> DataFrame:
    return ner.type_counts(_entities(s, d))


@query(sql_text.LINKED)
def ner_linked(s: SparkSession, d: str) -> DataFrame:
    """Entities with the concept of the best score among equal names: here the keywords, scored by their articles."""
    k = table(s, d, "pubmed_abstracts").where("pmid is not null").select("pmid", F.explode("keywords").alias("name")).where("name is not null")
    c = k.groupBy("name").agg(F.countDistinct("pmid").alias("score")).select("name", F.md5("name").alias("concept_id"), F.upper("name").alias("canonical"), "score")
    return ner.link(_entities(s, d), c).select("doc_id", "start", "end", "type", "concept_id", "concept_name")


@query("""select doc_id, list_transform(range(len(w) * 2 + 2), lambda k: case when k = 0 or k = len(w) * 2 + 1 or k % 2 = 0 then null else case when (k + 1) // 2 % 3 = 1 then 'B-X' when (k + 1) // 2 % 3 = 2 then 'I-X' else 'O' end end) as tags
  from (select doc_id, regexp_extract_all(text, '\\S+') as w from documents where text is not null)""")
def subword_tags(s: SparkSession, d: str) -> DataFrame:
    """Word tags carried over to sub-words, two per word, between two special tokens."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    words = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tag = F.transform(words, lambda k: F.when(k % 3 == 0, "B-X").when(k % 3 == 1, "I-X").otherwise("O"))
    none = F.array(F.lit(None).cast("int"))
    pieces = F.concat(none, F.flatten(F.transform(words, lambda k: F.array(k, k))), none)
    # columns of their own, so that the arrays are built once and not for each of their elements
    built = _docs(s, d).where("text is not null").select("doc_id", tag.alias("tag"), pieces.alias("pieces"))
    return built.select("doc_id", ner.align_tags(F.col("tag"), F.col("pieces")).alias("tags"))


def _abstracts(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "pubmed_abstracts").where("abstract is not null").select(F.col("rec_id").alias("doc_id"), F.col("abstract").alias("text")))


@query(sql.ddi())
def rel_ddi(s: SparkSession, d: str) -> DataFrame:
    return relations.drug_interactions(_abstracts(s, d)).select("doc_id", F.lower("subject").alias("subject"), F.lower("object").alias("object"), "kind", "confidence")


@query(sql_text.REL_ADR)
def rel_adr(s: SparkSession, d: str) -> DataFrame:
    return relations.adverse_reactions(_abstracts(s, d)).drop("start")


@query(sql.gene_disease())
def rel_gene_disease(s: SparkSession, d: str) -> DataFrame:
    return relations.gene_diseases(_abstracts(s, d)).select("doc_id", "subject", "object", "kind", "confidence")


@query(sql_text.REL_GRAPH)
def rel_graph(s: SparkSession, d: str) -> DataFrame:
    return relations.graph_edges(relations.all_relations(_abstracts(s, d)))


@query(sql_text.ENTITY_PAIRS)
def rel_entity_pairs(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "chunks").select(F.col("chunk_id").alias("doc_id"), "text")
    return relations.entity_pairs(docs, _entities(s, d)).select("doc_id", "pos", "first", "second", F.md5("marked").alias("hash"))


# benchmark scores ---------------------------------------------------------------------------------


@query(sql.LABEL_ACCURACY)
def pubmedqa_accuracy(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "eval_items").select(F.col("answer").alias("gold"), benchmarks.answer_label(F.concat_ws(" ", F.when(F.col("item_id") % 3 == 0, "Yes,").when(F.col("item_id") % 3 == 1, "It is no, as"), F.col("passage"))).alias("predicted"))
    return benchmarks.label_accuracy(e).select("label", r6("accuracy"), "n")


@query(sql.BIOASQ)
def bioasq_scores(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("item_id") % 4 == 0, "yesno").when(F.col("item_id") % 4 == 1, "factoid").when(F.col("item_id") % 4 == 2, "list").otherwise("summary")
    said = F.when(kind == "yesno", F.when(F.col("item_id") % 8 == 0, "Yes. ").otherwise("No. ")).when(kind == "list", "- yes\n- maybe\n- ").otherwise("")
    e = table(s, d, "eval_items").where("answer is not null").select(kind.alias("type"), F.concat(said, F.col("passage")).alias("predicted"), F.array("answer").alias("gold"))
    return benchmarks.bioasq(e).select("type", r6("score"), "n")


@query("""select round(avg((c = g)::int::double), 6) as accuracy, count(*) filter (c = g) as correct, count(*) as n from (select
  case when p = '' then 'A' else p end as c, chr((65 + item_id % 5)::int) as g from (select item_id, regexp_extract(regexp_replace('Answer ' || chr((65 + item_id % 3)::int) || ' since ' || passage, '[^\\x00-\\x7F]', '_', 'g'), '\\b([A-E])\\b', 1) as p from eval_items))""")
def medqa_accuracy(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "eval_items")
    said = F.concat(F.lit("Answer "), F.chr((65 + F.col("item_id") % 3).cast("bigint")), F.lit(" since "), "passage")
    r = benchmarks.choice_accuracy(e.select(said.alias("predicted"), F.chr((65 + F.col("item_id") % 5).cast("bigint")).alias("gold")))
    return r.select(r6("accuracy"), "correct", "n")


@query(sql.ENTITY_PRF)
def i2b2_prf(s: SparkSession, d: str) -> DataFrame:
    """Descriptors of an article scored as predictions against its keywords and descriptors as gold."""
    p = table(s, d, "pubmed_abstracts").where("pmid is not null")
    pred = p.select(F.col("pmid").alias("doc_id"), F.explode("mesh_terms").alias("text")).select("doc_id", "text", F.when(F.contains(F.col("text"), F.lit("/")), "DRUG").otherwise("DISEASE").alias("type"))
    gold = p.select(F.col("pmid").alias("doc_id"), F.explode(F.concat(F.coalesce("mesh_terms", F.array().cast("array<string>")), F.coalesce("keywords", F.array().cast("array<string>")))).alias("text")).where("text is not null")
    r = benchmarks.entity_prf(pred, gold.withColumn("type", F.lit("problem")))
    return r.select("type", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


# articles -----------------------------------------------------------------------------------------


@query("""select 'pmid_' || pmid as doc_id, rec_id, md5('Title: ' || coalesce(title, '') || chr(10) || chr(10) || 'Abstract: ' || coalesce(abstract, '')) as hash,
  case when regexp_matches(left(pub_date, 4), '^[0-9]{4}$') then left(pub_date, 4)::int end as pub_year from pubmed_abstracts where pmid is not null""")
def article_documents(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pubmed_abstracts")
    docs = pubmed.to_documents(p.withColumn("doi", F.col("rec_id").cast("string")))
    return docs.select("doc_id", F.col("doi").cast("bigint").alias("rec_id"), F.md5("text").alias("hash"), "pub_year")


@query("""select pmid, part, rec_id from (select *, row_number() over (partition by pmid order by part, rec_id) as i from (
  select distinct pmid, part, rec_id from (select pmid, rec_id, lower(trim(split_part(unnest(mesh_terms), '/', 1))) as m from pubmed_abstracts where pmid is not null)
  join (values ('humans', 0), ('female', 1), ('renal diseases', 2)) t(term, part) on m = term)) where i = 1""")
def category_dedup(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pubmed_abstracts").where("pmid is not null").select("pmid", "rec_id", "mesh_terms")
    u = pubmed.first_wins([pubmed.by_mesh(p, t).select("pmid", "rec_id") for t in ("humans", "female", "renal diseases")], "pmid", "rec_id")
    return u.select("pmid", "part", "rec_id")


@query("""select pmid, part, rec_id from (select *, row_number() over (partition by pmid order by part, rec_id) as i from (
  select distinct pmid, part, rec_id from (select pmid, rec_id, lower(trim(split_part(unnest(mesh_terms), '/', 1))) as m from pubmed_abstracts where pmid is not null)
  join (values ('atrial fibrillation', 0), ('heart failure', 1), ('myocardial infarction', 2), ('coronary artery disease', 3), ('hypertension', 4)) t(term, part) on m = term)) where i = 1""")
def domain_articles(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "pubmed_abstracts").where("pmid is not null").select("pmid", "rec_id", "mesh_terms", "pub_date")
    return pubmed.by_domain(p, "cardiology", "rec_id").select("pmid", "part", "rec_id")


@query("""select rec_id from pubmed_abstracts where list_contains(list_transform(mesh_terms, lambda m: lower(trim(split_part(m, '/', 1)))), 'humans')
  and regexp_matches(left(pub_date, 4), '^[0-9]{4}$') and try_cast(left(pub_date, 4) as int) between 2005 and 2015""")
def mesh_years(s: SparkSession, d: str) -> DataFrame:
    return pubmed.by_mesh(table(s, d, "pubmed_abstracts"), "humans", 2005, 2015).select("rec_id")


# events -------------------------------------------------------------------------------------------


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def audit_daily(s: SparkSession, d: str) -> DataFrame:
    return audit.windowed_counts(table(s, d, "events")).withColumn("total", F.round("total", 6))


@query("""select window_start, event_type, count(*) as n, round(sum(value), 6) as total from (
  select date_trunc('hour', ts) - (h * interval 1 hour) as window_start, event_type, value from events, (values (0), (1)) t(h)) group by 1, 2""")
def sliding_counts(s: SparkSession, d: str) -> DataFrame:
    return audit.windowed_counts(table(s, d, "events"), "2 hours", "1 hour").withColumn("total", F.round("total", 6))


@query("""select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from (
  select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from (
    select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events)) group by user_id, k""")
def sessions(s: SparkSession, d: str) -> DataFrame:
    return audit.sessions(table(s, d, "events"))


@query("""select e.row_id, r.value, r.event_type from (select event_id as row_id, user_id, ts from events where event_type = 'purchase') e
  asof left join (select user_id, ts, max({'v': value, 't': event_type}) as m from events where event_type <> 'purchase' group by 1, 2) x on e.user_id = x.user_id and e.ts >= x.ts, lateral (select m.v as value, m.t as event_type) r""")
def events_asof(s: SparkSession, d: str) -> DataFrame:
    """Each purchase with the latest other event of its user."""
    e = table(s, d, "events")
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("row_id"), "user_id", "ts")
    right = e.where("event_type != 'purchase'").select("user_id", "ts", "value", "event_type")
    return tables.asof_join(left, right, "user_id", "ts", ["value", "event_type"]).select("row_id", "value", "event_type")


@query("select event_type, count(*) as n, true as distinct_near, true as quantiles_near from events group by 1")
def events_profile(s: SparkSession, d: str) -> DataFrame:
    """Whether approximate distinct counts and quantiles lie near the exact ones, by event type."""
    e = table(s, d, "events")
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.percentile("value", [0.45, 0.55, 0.88, 0.92]).alias("q"))
    p = tables.profile(e, "event_type", "value", distinct=F.col("user_id")).join(exact, "event_type")
    near = (F.abs(F.col("distinct_values") - F.col("users")) <= 1 + 0.1 * F.col("users")).alias("distinct_near")
    within = F.col("quantiles")[0].between(F.col("q")[0], F.col("q")[1]) & F.col("quantiles")[1].between(F.col("q")[2], F.col("q")[3])
    return p.select("event_type", "n", near, within.alias("quantiles_near"))


@query("select user_id, count(*) as n, round(sum(coalesce(value, 0)), 6) as total from events group by 1")
def stream_state(s: SparkSession, d: str) -> DataFrame:
    """The events replayed as a stream with state per user: the last row that each user sent out."""
    batch = table(s, d, "events")
    where = f"{scratch_root(s)}/state-{uuid.uuid4().hex}"
    stream = s.readStream.schema(batch.schema).parquet(f"{d}/events.parque[t]")
    q = (
        audit.running_totals(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", where + "/state")
        .foreachBatch(lambda df, i: df.write.mode("append").parquet(where + "/out")).start()
    )
    q.awaitTermination()
    g = s.read.parquet(where + "/out").groupBy("user_id").agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))
    return g.select("user_id", "n", F.round("total", 6).alias("total"))


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def stream_counts(s: SparkSession, d: str) -> DataFrame:
    """The events replayed as a stream: the last state of every daily window."""
    batch = table(s, d, "events")
    where = f"{scratch_root(s)}/stream-{uuid.uuid4().hex}"
    stream = s.readStream.schema(batch.schema).parquet(f"{d}/events.parque[t]")  # a pattern, so that a single file can be streamed
    q = (
        audit.windowed_counts(stream, late="60 days").writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", where + "/state")
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(where + "/out")).start()
    )
    q.awaitTermination()
    return s.read.parquet(where + "/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
