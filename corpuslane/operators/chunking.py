"""Chunks of documents: by sentences with overlap, by meaning, by section."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import sentences_biomedical, token_estimate
from corpuslane.operators.embedding import Provider, cosine

_SENT = "array<struct<s:string,t:int>>"


def _fold(sentences: Column, size: int, overlap: int, least: int) -> Column:
    """Greedy chunks of a sentence list as array of (first, text, last), last being true for the remainder.

    A chunk is closed when the next sentence would take it over ``size`` tokens; the next one begins with
    the closed one's last sentences up to ``overlap`` tokens. The remainder needs ``least`` tokens.
    """
    pairs = F.transform(sentences, lambda s: F.struct(s.alias("s"), token_estimate(s).alias("t")))
    none = F.array().cast(_SENT)
    empty = F.array().cast("array<struct<first:string,text:string,rest:boolean>>")
    start = F.struct(empty.alias("done"), none.alias("cur"), F.lit(0).alias("n"))

    def text_of(cur: Column) -> Column:
        return F.array_join(F.transform(cur, lambda x: x["s"]), " ")

    def carry(cur: Column) -> Column:
        init = F.struct(none.alias("keep"), F.lit(0).alias("n"), F.lit(False).alias("stop"))
        return F.aggregate(
            F.reverse(cur), init,
            lambda a, x: F.when(a["stop"] | (a["n"] + x["t"] > overlap), F.struct(a["keep"].alias("keep"), a["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(
                F.struct(F.concat(F.array(x), a["keep"]).alias("keep"), (a["n"] + x["t"]).alias("n"), F.lit(False).alias("stop"))
            ),
        )

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] + x["t"] > size) & (F.size(a["cur"]) > 0)
        closed = F.struct(F.element_at(a["cur"], 1)["s"].alias("first"), text_of(a["cur"]).alias("text"), F.lit(False).alias("rest"))
        back = carry(a["cur"])
        return F.when(
            full,
            F.struct(F.concat(a["done"], F.array(closed)).alias("done"), F.concat(back["keep"], F.array(x)).alias("cur"), (back["n"] + x["t"]).alias("n")),
        ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["cur"], F.array(x)).alias("cur"), (a["n"] + x["t"]).alias("n")))

    def finish(a: Column) -> Column:
        rest = F.struct(F.element_at(a["cur"], 1)["s"].alias("first"), text_of(a["cur"]).alias("text"), F.lit(True).alias("rest"))
        good = (F.size(a["cur"]) > 0) & (token_estimate(rest["text"]) >= least)
        return F.when(good, F.concat(a["done"], F.array(rest))).otherwise(a["done"])

    return F.aggregate(pairs, start, step, finish)


def sentence_chunks(docs: DataFrame, chunk_size: int = 512, overlap: int = 64, min_chunk_size: int = 50) -> DataFrame:
    """Chunks of (doc_id, text): chunk_id, doc_id, chunk_index, text, token_count, char_start, char_end.

    char_start is where the chunk's first sentence first occurs in the text (the remainder's: last
    occurs), 0 if sentence splitting changed it. Texts whose only chunk is under ``min_chunk_size``
    tokens, null and empty texts give no chunk.
    """
    d = docs.where(F.col("text").isNotNull()).select("doc_id", "text", sentences_biomedical(F.col("text")).alias("_s"))
    e = d.select("doc_id", F.col("text").alias("_t"), F.posexplode(_fold(F.col("_s"), chunk_size, overlap, min_chunk_size)).alias("chunk_index", "_c"))
    first = F.instr(F.col("_t"), F.col("_c.first")) - 1
    behind = F.length("_t") - F.length("_c.first") - (F.instr(F.reverse("_t"), F.reverse("_c.first")) - 1)
    last = F.when(F.instr(F.col("_t"), F.col("_c.first")) > 0, behind).otherwise(-1)
    at = F.greatest(F.when(F.col("_c.rest"), last).otherwise(first), F.lit(0))
    return e.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "chunk_index", F.col("_c.text").alias("text"), token_estimate(F.col("_c.text")).alias("token_count"),
        at.cast("int").alias("char_start"), (at + F.length("_c.text")).cast("int").alias("char_end"),
    )


def breakpoints(sents: DataFrame, key: str, pos: str, vec: str, percentile: float = 85.0) -> DataFrame:
    """``sents`` with ``sim`` (cosine to the next one of its key) and ``is_break``: sim below the key's (100 - p)th percentile."""
    w = Window.partitionBy(key).orderBy(pos)
    d = sents.withColumn("sim", cosine(F.col(vec), F.lead(vec).over(w)))
    cut = d.groupBy(key).agg(F.percentile("sim", (100 - percentile) / 100).alias("_cut"))
    return d.join(cut, key).withColumn("is_break", F.coalesce(F.col("sim") < F.col("_cut"), F.lit(False))).drop("_cut")


def _breaks(sentences: Column, model: Provider, percentile: float) -> Column:
    """After how many sentences of a document a group ends, because the next sentence differs most; the last end is the document's."""

    @F.arrow_udf("array<int>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            sizes = np.diff(b.offsets.to_numpy())
            flat = b.flatten().to_pylist()
            v = model.encode(flat).astype(np.float64) if flat else np.empty((0, 1))
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
            # rounded, so that equal similarities stay equal however they were added up
            every = np.round((v[:-1] * v[1:]).sum(1), 9)
            out, at = [], 0
            for n in sizes.tolist():
                sim = every[at : at + max(n - 1, 0)]
                at += n
                # two sentences differ from nothing else
                ends = np.flatnonzero(sim < np.round(np.percentile(sim, 100 - percentile), 9)) + 1 if n > 2 else []
                out.append([*map(int, ends), n])
            yield pa.array(out, pa.list_(pa.int32()))

    return cut(sentences)


def semantic_chunks(docs: DataFrame, model: Provider, percentile: float = 85.0, max_tokens: int = 512, min_tokens: int = 50, overlap: int = 64) -> DataFrame:
    """Chunks of (doc_id, text) cut where neighbouring sentences differ most in meaning.

    A break is where the cosine of two neighbours is below the document's (100 - ``percentile``)th
    percentile. Documents under three sentences are one group. Groups under ``min_tokens`` are
    dropped, those over ``max_tokens`` are cut again by sentences. Result: doc_id, chunk_index, text,
    token_count. A document is cut where it lies: no shuffle. Sentences go to Python once, only the
    places of the breaks come back.
    """
    d = docs.where(F.col("text").isNotNull()).select("doc_id", sentences_biomedical(F.col("text")).alias("_s"))
    g = d.select("doc_id", "_s", _breaks(F.col("_s"), model, percentile).alias("_e"))
    begins = F.concat(F.array(F.lit(0)), F.slice("_e", 1, F.size("_e") - 1))

    def pieces(ss: Column) -> Column:
        whole = F.array_join(ss, " ")
        again = F.transform(_fold(ss, max_tokens, overlap, min_tokens), lambda c: c["text"])
        size = token_estimate(whole)
        return F.when(size < min_tokens, F.array().cast("array<string>")).when(size <= max_tokens, F.array(whole)).otherwise(again)

    groups = F.zip_with(begins, "_e", lambda a, e: F.slice("_s", a + 1, e - a))
    rows = g.select("doc_id", groups.alias("g")).select("doc_id", F.posexplode(F.flatten(F.transform("g", pieces))).alias("chunk_index", "text"))
    return rows.withColumn("token_count", token_estimate(F.col("text")))


def section_chunks(sections: DataFrame, chunk_size: int = 384, overlap: int = 48, min_chunk_size: int = 50) -> DataFrame:
    """Chunks of (doc_id, ord, section_name, text), each section on its own, numbered through per document."""
    key = sections.select(F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.col("ord").cast("string"), "section_name").alias("doc_id"), "text")
    c = sentence_chunks(key, chunk_size, overlap, min_chunk_size)
    part = F.split("doc_id", "\u0001")
    c = c.select(
        F.element_at(part, 1).alias("doc_id"), F.element_at(part, 2).cast("int").alias("ord"), F.element_at(part, 3).alias("section_name"),
        F.col("chunk_index").alias("_k"), "text", "token_count",
    )
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "_k")) - 1
    return c.withColumn("chunk_index", n).drop("_k")


def chunk(docs: DataFrame, method: str = "sentence", model: Provider | None = None, **options) -> DataFrame:
    """Chunks by name of the method: ``sentence``, ``semantic`` (needs a ``model``) or ``section``."""
    if method == "sentence":
        return sentence_chunks(docs, **options)
    if method == "semantic":
        if model is None:
            raise ValueError("semantic chunking needs an embedder")
        return semantic_chunks(docs, model, **options)
    if method == "section":
        return section_chunks(docs, **options)
    raise ValueError(f"unknown method {method!r}")
