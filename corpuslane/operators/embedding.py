"""Embeddings: vector arithmetic on array columns, pluggable providers, a cache table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-8


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; lengths count as at least 1e-8."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))


def l2_normalise(v: Column) -> Column:
    """The vector divided by its length (at least 1e-8), as doubles."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(FLOOR)))


class Provider(Protocol):
    """Turns texts into vectors of ``dim`` floats; ``name`` keys the cache."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingProvider:
    """Default provider: each word adds its sign at a coordinate, both from the word's MD5. Deterministic.

    ``unit`` scales vectors to length 1; without it they hold whole numbers, exact as floats.
    """

    dim: int = 64
    unit: bool = True
    name: str = "hashing-64"

    def encode(self, texts: list[str]) -> np.ndarray:
        cache = _WORDS.setdefault(self.dim, {})
        if len(cache) > 500_000:
            cache.clear()
        at, sign, row = [], [], []
        for k, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                x = cache.get(w)
                if x is None:
                    h = int(hashlib.md5(w.encode()).hexdigest()[:6], 16)
                    x = cache[w] = ((h // 2) % self.dim, 1.0 if h % 2 == 0 else -1.0)
                at.append(x[0])
                sign.append(x[1])
                row.append(k)
        flat = np.bincount(np.array(row, np.int64) * self.dim + np.array(at, np.int64), weights=np.array(sign), minlength=len(texts) * self.dim)
        out = flat.reshape(len(texts), self.dim)
        if self.unit:
            out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), FLOOR)
        return out.astype(np.float32)


_WORD = re.compile(r"[a-z0-9]+")
_WORDS: dict[int, dict] = {}

#: Providers by name; models are registered by the user.
REGISTRY: dict[str, Callable[[], Provider]] = {
    "hashing-64": HashingProvider,
    "hashing-16": lambda: HashingProvider(16, True, "hashing-16"),
    "hashing-256": lambda: HashingProvider(256, True, "hashing-256"),
}


def provider(name: str) -> Provider:
    """The registered provider of that name."""
    return REGISTRY[name]()


def embed(text: Column, model: Provider) -> Column:
    """Vectors of a text column by an Arrow UDF; a worker keeps its model over batches. Null text gives null."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            vec = model.encode([t or "" for t in b.to_pylist()])
            off = pa.array(np.arange(len(b) + 1, dtype=np.int32) * vec.shape[1])
            yield pa.ListArray.from_arrays(off, pa.array(vec.ravel(), pa.float32()), mask=b.is_null()) if len(b) else pa.array([], pa.list_(pa.float32()))

    return run(text)


def cache_key(model: str, text: Column) -> Column:
    """Key of a text in the cache of a model."""
    return F.md5(F.concat(F.lit(model + "::"), text))


def cache_split(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows of ``texts`` whose (model, key) is in ``cache`` (model, key, vector), and distinct texts that are not."""
    keyed = texts.withColumn("key", cache_key(model, F.col(text)))
    mine = cache.where(F.col("model") == model).select("key", "vector")
    hits = keyed.join(mine, "key")
    misses = keyed.join(mine.select("key"), "key", "left_anti").where(F.col(text).isNotNull()).select("key", text).dropDuplicates(["key"])
    return hits, misses


def fill_cache(texts: DataFrame, cache: DataFrame, model: Provider, text: str = "text") -> DataFrame:
    """Rows to append to the cache: (model, key, vector) of the texts that it lacks."""
    _, misses = cache_split(texts, cache, model.name, text)
    return misses.select(F.lit(model.name).alias("model"), "key", embed(F.col(text), model).alias("vector"))


def compare_providers(scores: DataFrame) -> DataFrame:
    """Per provider mean reciprocal rank and mean similarity of the right document.

    ``scores``: (provider, query_id, doc_id, right boolean, score) with one right document per query.
    """
    r = F.row_number().over(Window.partitionBy("provider", "query_id").orderBy(F.desc("score"), "doc_id"))
    hit = scores.withColumn("rank", r).where("right")
    return hit.groupBy("provider").agg(F.avg(1 / F.col("rank")).alias("mrr"), F.avg("score").alias("avg_sim"))


def contrastive_pairs(queries: DataFrame, docs: DataFrame, truth: DataFrame, negatives: DataFrame | None = None) -> DataFrame:
    """Training pairs (query, positive, negative): each true (query_id, doc_id) once, with texts of both.

    ``queries`` and ``docs``: (query_id or doc_id, text). ``negatives``, ranked hits (query_id, doc_id, rank),
    give each pair the best-ranked document that is not true for its query; null without one. Pairs with a
    null or empty text are left out.
    """
    t = truth.select("query_id", "doc_id").distinct()
    q = queries.where("text is not null and text != ''").select("query_id", F.col("text").alias("query"))
    d = docs.where("text is not null and text != ''").select("doc_id", "text")
    pairs = t.join(q, "query_id").join(d.withColumnRenamed("text", "positive"), "doc_id")
    if negatives is None:
        return pairs.select("query", "positive", F.lit(None).cast("string").alias("negative"))
    hard = negatives.join(t, ["query_id", "doc_id"], "left_anti").groupBy("query_id").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("doc_id"))
    hard = hard.join(d.withColumnRenamed("text", "negative"), "doc_id").select("query_id", "negative")
    return pairs.join(hard, "query_id", "left").select("query", "positive", "negative")
