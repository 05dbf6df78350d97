"""Context for answers: selection under a token budget, prompts, citations, confidence, providers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import sentences_plain, word_count, word_set

REFUSAL = "The retrieved documents do not hold enough information to answer this question."
DISCLAIMER = "Note for clinicians: this text was generated from retrieved documents and does not replace professional judgement."

PROMPTS = {
    "clinical_qa": "Answer the clinical question from the numbered documents only. Cite each statement as [Doc N], name gaps in the evidence and close with a line 'Confidence level: high, medium or low'.",
    "literature_synthesis": "Summarise what the numbered documents say about the question: agreement, conflicts, strength of evidence. Cite each statement as [Doc N].",
    "adverse_event_extraction": "List every adverse event that the numbered documents report, with drug, severity and frequency where given. Cite each as [Doc N].",
}


def select_context(hits: DataFrame, most: int = 8, budget: float = 3000.0) -> DataFrame:
    """The first ``most`` hits of each query (query_id, rank, text) as long as their estimated tokens fit ``budget``.

    Tokens are 1.3 times the words, unrounded. The first hit that overflows ends the context; ``cum_tokens``
    is the running sum.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    d = hits.where(F.col("rank") <= most).withColumn("cum_tokens", F.sum(F.coalesce(word_count(F.col("text")), F.lit(0)) * F.lit(1.3)).over(w))
    return d.where(F.col("cum_tokens") <= budget)


def document_header(n: Column, pmid: Column, journal: Column, pub_date: Column, title: Column, note_id: Column, note_type: Column, section: Column) -> Column:
    """Head line of a context document: an article, a note, or just its number."""
    doc = F.concat(F.lit("[Doc "), n.cast("string"), F.lit("]"))

    def or_(c: Column, other: str) -> Column:
        return F.coalesce(c, F.lit(other))

    article = F.concat(doc, F.lit(" PMID: "), pmid, F.lit(" | "), or_(journal, ""), F.lit(" ("), F.substring(or_(pub_date, ""), 1, 4), F.lit(")"))
    article = F.when(or_(title, "") != "", F.concat(article, F.lit("\nTitle: "), title)).otherwise(article)
    note = F.concat(doc, F.lit(" Clinical Note: "), note_id, F.lit(" | Type: "), or_(note_type, "unknown"), F.lit(" | Section: "), or_(section, "full_note"))
    return F.when(or_(pmid, "") != "", article).when(or_(note_id, "") != "", note).otherwise(doc)


def format_context(selected: DataFrame) -> DataFrame:
    """(query_id, context, citations, n_citations, documents) of selected hits with ``rank``, ``doc_id``, ``text``, ``score`` and the metadata of :func:`document_header`.

    Missing metadata columns count as null. Citations are (n, doc_id, snippet of 200 characters, score),
    documents (n, text) with the whole text, null as ''.
    A query's context is at most the few documents that were selected for it.
    """
    d = selected
    for c in ("pmid", "journal", "pub_date", "title", "note_id", "note_type", "section"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    d = d.withColumn("n", n)
    head = document_header(*[F.col(c) for c in ("n", "pmid", "journal", "pub_date", "title", "note_id", "note_type", "section")])
    d = d.withColumn("line", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")))
    d = d.withColumn("cite", F.struct("n", F.col("doc_id").cast("string").alias("doc_id"), F.substring("text", 1, 200).alias("snippet"), "score"))
    d = d.withColumn("body", F.coalesce("text", F.lit("")))
    g = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "line", "cite", "body"))).alias("x"))
    return g.select(
        "query_id", F.array_join(F.transform("x", lambda y: y["line"]), "\n---\n").alias("context"), F.transform("x", lambda y: y["cite"]).alias("citations"), F.size("x").alias("n_citations"),
        F.transform("x", lambda y: F.struct(y["n"].alias("n"), y["body"].alias("text"))).alias("documents"),
    )


def citation_display(pmid: Column, title: Column, note_id: Column, chunk_id: Column) -> Column:
    """How a citation is shown."""
    return (
        F.when(F.coalesce(pmid, F.lit("")) != "", F.concat(F.lit("[PMID: "), pmid, F.lit("] "), F.coalesce(title, F.lit(""))))
        .when(F.coalesce(note_id, F.lit("")) != "", F.concat(F.lit("[Clinical Note: "), note_id, F.lit("]")))
        .otherwise(F.concat(F.lit("["), chunk_id, F.lit("]")))
    )


def user_message(question: Column, context: Column) -> Column:
    """The user's part of the prompt."""
    return F.concat(F.lit("Documents:\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question, F.lit("\n\nAnswer from the documents above only."))


def confidence(text: Column) -> Column:
    """Confidence that an answer states: high .85, medium .60, low .35, no evidence .10, silent .70; the first rule that fits."""
    low = F.lower(text)

    def says(*phrases: str) -> Column:
        c = F.lit(False)
        for p in phrases:
            c = c | F.contains(low, F.lit(p))
        return c

    return (
        F.when(says("confidence level: high", "high confidence"), 0.85)
        .when(says("confidence level: medium", "moderate confidence"), 0.60)
        .when(says("confidence level: low", "low confidence"), 0.35)
        .when(says("insufficient evidence", "cannot answer", "not enough information", "context does not contain"), 0.10)
        .otherwise(0.70)
    )


class Generator(Protocol):
    """Answers prompts; ``stream`` yields parts of one answer."""

    def generate(self, system: str, user: list[str]) -> list[str]: ...

    def stream(self, system: str, user: str) -> Iterator[str]: ...


def stream(model: Generator, question: str, context: str, task: str = "clinical_qa") -> Iterator[str]:
    """Parts of one answer as the model writes them, then the disclaimer of the clinical task; without context the refusal.

    One question at a time, for display; tables of questions go through :func:`generate`.
    """
    if not context:
        yield REFUSAL
        return
    user = f"Documents:\n\n{context}\n\n---\n\nQuestion: {question}\n\nAnswer from the documents above only."
    yield from model.stream(PROMPTS.get(task, PROMPTS["clinical_qa"]), user)
    if task == "clinical_qa":
        yield f"\n\n{DISCLAIMER}"


def extractive_answer(question: Column, documents: Column, most: int = 3) -> Column:
    """Default answer: of each of the first ``most`` documents (n, text) the first sentence, cited."""
    parts = F.transform(
        F.slice(documents, 1, most),
        lambda c: F.concat(F.coalesce(F.get(sentences_plain(c["text"]), F.lit(0)), F.lit("")), F.lit(" [Doc "), c["n"].cast("string"), F.lit("]")),
    )
    shared = F.size(F.array_intersect(word_set(question), F.array_distinct(F.flatten(F.transform(documents, lambda c: word_set(c["text"]))))))
    level = F.when(shared >= F.size(word_set(question)) / 2, "high").when(shared > 0, "medium").otherwise("low")
    return F.concat(F.array_join(parts, " "), F.lit("\n\nConfidence level: "), level)


def generate(contexts: DataFrame, queries: DataFrame, task: str = "clinical_qa", model: Generator | None = None, least_confidence: float = 0.0) -> DataFrame:
    """(query_id, answer, confidence, citations, n_citations) for every (query_id, text).

    Without context the answer is a refusal of confidence 0; below ``least_confidence`` it is one, too. The
    clinical task adds a disclaimer. ``model`` is called in Arrow batches; without one the answer is
    extractive.
    """
    system = PROMPTS.get(task, PROMPTS["clinical_qa"])
    d = queries.select("query_id", "text").join(contexts, "query_id", "left")
    if model is None:
        d = d.withColumn("raw", extractive_answer(F.col("text"), F.col("documents")))
    else:

        @F.arrow_udf("string")
        def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array(model.generate(system, b.to_pylist()), pa.string())

        d = d.withColumn("raw", F.when(F.col("n_citations") > 0, ask(user_message(F.col("text"), F.coalesce("context", F.lit(""))))))
    d = d.withColumn("c", F.when(F.coalesce("n_citations", F.lit(0)) == 0, 0.0).otherwise(confidence(F.col("raw"))))
    good = (F.coalesce("n_citations", F.lit(0)) > 0) & (F.col("c") >= least_confidence)
    tail = f"\n\n{DISCLAIMER}" if task == "clinical_qa" else ""
    return d.select(
        "query_id", F.when(good, F.concat("raw", F.lit(tail))).otherwise(REFUSAL).alias("answer"), F.col("c").alias("confidence"), "citations", F.coalesce("n_citations", F.lit(0)).alias("n_citations")
    )
