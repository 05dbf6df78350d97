"""Metrics of retrieval and generation, as tables."""

from __future__ import annotations

import functools
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions.text import ngrams, sentences_plain, word_set
from corpuslane.operators.embedding import Provider


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, precision, recall, ndcg, mrr, n_queries) of (query_id, doc_id, rank) against (query_id, doc_id).

    Queries are those of ``ranked``; one without truth counts 0 in every mean. Precision divides by k also
    where fewer were retrieved; MRR takes the first hit of the whole list; gains are binary.
    """
    t = truth.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    size = t.groupBy("query_id").agg(F.count("*").alias("relevant"))
    j = ranked.select("query_id", "doc_id", "rank").join(t, ["query_id", "doc_id"], "left")
    hit = F.col("hit") == 1

    def at(k: int) -> list[Column]:
        return [
            F.count_if(hit & (F.col("rank") <= k)).alias(f"h{k}"),
            F.sum(F.when(hit & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"g{k}"),
        ]

    q = j.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), *[c for k in ks for c in at(k)])
    q = q.join(size, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    some = F.col("relevant") > 0

    def row(k: int) -> Column:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.col("relevant")), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        return F.struct(
            F.lit(k).alias("k"), (F.col(f"h{k}") / k).alias("p"), F.when(some, F.col(f"h{k}") / F.col("relevant")).otherwise(0.0).alias("r"),
            F.when(some, F.col(f"g{k}") / ideal).otherwise(0.0).alias("g"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("m"),
        )

    e = q.select(F.explode(F.array(*[row(k) for k in ks])).alias("x")).select("x.*")
    return e.groupBy("k").agg(
        F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("g").alias("ndcg"), F.avg("m").alias("mrr"), F.count("*").alias("n_queries")
    )


def bleu(pairs: DataFrame, order: int = 4) -> DataFrame:
    """One row (bleu, n): corpus BLEU of (id, hypothesis, reference), words split at white space, in lower case.

    Clipped matches and totals are summed over the corpus per length of n-gram; a length without a match
    counts 1 / 2^n if it has any n-gram and 0 else; short output is penalised.
    """
    w = pairs.where("hypothesis is not null and reference is not null").select("id", *[F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0)).alias(c) for c in ("hypothesis", "reference")])
    sides = w.select("id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("n"), ngrams(F.col(c), n).alias("g")) for s, c in ((0, "hypothesis"), (1, "reference")) for n in range(1, order + 1)])).alias("x"))
    grams = sides.select("id", "x.side", "x.n", F.explode("x.g").alias("g"))
    counts = grams.groupBy("id", "n", "g").agg(F.count_if(F.col("side") == 0).alias("h"), F.count_if(F.col("side") == 1).alias("r"))
    per = counts.agg(*[F.sum(F.when(F.col("n") == n, F.least("h", "r")).otherwise(0)).alias(f"m{n}") for n in range(1, order + 1)], *[F.sum(F.when(F.col("n") == n, F.col("h")).otherwise(0)).alias(f"t{n}") for n in range(1, order + 1)])
    size = w.agg(F.sum(F.size("hypothesis")).alias("hl"), F.sum(F.size("reference")).alias("rl"), F.count("*").alias("n"))
    j = per.join(size)

    def precision(n: int) -> Column:
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        return F.when(m > 0, m / t).when(t > 0, F.lit(1.0 / 2**n)).otherwise(0.0)

    mean = reduce(lambda a, b: a + b, [F.ln(F.greatest(precision(n), F.lit(1e-10))) for n in range(1, order + 1)]) / order
    penalty = F.when(F.coalesce("hl", F.lit(0)) == 0, 0.0).when(F.col("hl") >= F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.col("hl")))
    return j.select((penalty * F.exp(mean)).alias("bleu"), "n")


def rouge_sets(hypothesis: Column, reference: Column) -> Column:
    """ROUGE by sets of words: F1 as rouge1 and rougeL, 0 as rouge2."""
    h, r = word_set(hypothesis), word_set(reference)
    both = F.size(F.array_intersect(h, r))
    f = F.when((F.size(h) > 0) & (F.size(r) > 0) & (both > 0), 2.0 * both / (F.size(h) + F.size(r))).otherwise(0.0)
    return F.struct(f.alias("rouge1"), F.lit(0.0).alias("rouge2"), f.alias("rougeL"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one addition of long integers per word of ``b``."""
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    v = every
    for y in b:
        hit = v & at.get(y, 0)
        v = ((v + hit) | (v - hit)) & every
    return len(a) - v.bit_count()


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall(r"[aeiouy]+[^aeiouy]", re.sub(r"(?:^|(?<=[aeiou]))y", "Y", w)))


def _vowel(w: str) -> bool:
    return bool(re.search(r"[aeiou]|(?<=[^aeiou])y", w))


def _short(w: str) -> bool:
    """Whether a stem ends consonant, vowel, consonant, the last being none of w, x, y."""
    return bool(re.search(r"(?:^|[^aeiou])[aeiouy][^aeiouwxy]$", w)) and len(w) > 2


# The suffixes of the second, third and fourth step of Porter's stemmer.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


@functools.lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """Porter's stemmer; words of up to three letters stay."""
    if len(w) <= 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        m = re.match(r"(.*)(?:ed|ing)$", w)
        if m and _vowel(m[1]):
            w = m[1]
            if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _short(w):
                w += "e"
            elif re.search(r"([^aeioulsz])\1$", w):
                w = w[:-1]
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for pair in sorted(table.split(), key=len, reverse=True):
            old, _, new = pair.partition(":")
            if w.endswith(old):
                w = w[: -len(old)] + new if _measure(w[: -len(old)]) else w
                break
    for old in sorted(_STEP4.split(), key=len, reverse=True):
        if w.endswith(old):
            base = w[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def rouge(hypothesis: Column, reference: Column, stemmed: bool = True) -> Column:
    """ROUGE-1, -2 (clipped counts) and -L (longest common subsequence) as F1; words are runs of letters and digits, ``stemmed`` by Porter's rules."""

    def f1(hit: int, a: int, b: int) -> float:
        return 2 * hit / (a + b) if hit else 0.0

    def words(t: str | None) -> list[str]:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return [stem(x) for x in w] if stemmed else w

    @F.pandas_udf("struct<rouge1:double,rouge2:double,rougeL:double>")
    def run(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(h, r, strict=True):
            a, b = words(x), words(y)
            two = [Counter(zip(t, t[1:], strict=False)) for t in (a, b)]
            out.append(
                (
                    f1(sum((Counter(a) & Counter(b)).values()), len(a), len(b)),
                    f1(sum((two[0] & two[1]).values()), max(len(a) - 1, 0), max(len(b) - 1, 0)),
                    f1(lcs(a, b), len(a), len(b)),
                )
            )
        return pd.DataFrame(out, columns=["rouge1", "rouge2", "rougeL"])

    return run(hypothesis, reference)


def embedding_score(hypothesis: Column, reference: Column, model: Provider) -> Column:
    """Precision, recall and F1 of two texts by their words' vectors: each word counts its best cosine on the other side, at least 0.

    ``model`` is any embedder; with a contextual one this is the greedy matching of the usual embedding
    score. Null counts as empty; an empty side gives 0.
    """

    def unit(words: list[str]) -> np.ndarray:
        v = np.asarray(model.encode(words), np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)

    @F.pandas_udf("struct<precision:double,recall:double,f1:double>")
    def run(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(h, r, strict=True):
            a, b = re.findall(r"[^\W_]+", (x or "").lower()), re.findall(r"[^\W_]+", (y or "").lower())
            if not a or not b:
                out.append((0.0, 0.0, 0.0))
                continue
            s = np.maximum(unit(a) @ unit(b).T, 0.0)
            p, q = float(s.max(1).mean()), float(s.max(0).mean())
            out.append((p, q, 2 * p * q / (p + q) if p + q else 0.0))
        return pd.DataFrame(out, columns=["precision", "recall", "f1"])

    return run(hypothesis, reference)


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(empty))


def answer_scores(question: Column, answer: Column, passages: Column, truth: Column) -> Column:
    """Reference-free scores of an answer given its passages (array): a struct of five.

    faithfulness: of the answer's sentences over 20 characters the share of which one of the first five words
    stands in the first five passages (1 if there are none). relevance: twice the share of the question's
    words in the answer, at most 1. context_recall: share of the truth's words in the passages (1 if it has
    none). context_precision: share of passages with over 15 % of the question's words. overall: harmonic
    mean of those above 0.
    """
    joined = F.lower(F.array_join(F.slice(passages, 1, 5), " "))
    long = F.filter(sentences_plain(answer), lambda s: F.length(s) > 20)
    held = F.filter(long, lambda s: F.exists(F.slice(F.split(F.lower(s), r"\s+"), 1, 5), lambda w: F.contains(joined, w)))
    faith = F.when(F.size(long) > 0, F.size(held) / F.size(long)).otherwise(1.0)
    q = word_set(question)
    rel = F.least(2 * _share(q, word_set(answer), 0.0), F.lit(1.0))
    everything = F.array_distinct(F.flatten(F.transform(passages, lambda p: word_set(p))))
    rec = _share(word_set(truth), everything, 1.0)
    prec = F.when(F.size(passages) > 0, F.size(F.filter(passages, lambda p: _share(q, word_set(p), 0.0) > 0.15)) / F.size(passages)).otherwise(0.0)
    parts = F.filter(F.array(faith, rel, rec, prec), lambda x: x > 0)
    overall = F.when(F.size(parts) > 0, F.size(parts) / F.aggregate(parts, F.lit(0.0), lambda s, x: s + 1 / x)).otherwise(0.0)
    return F.struct(faith.alias("faithfulness"), rel.alias("relevance"), rec.alias("context_recall"), prec.alias("context_precision"), overall.alias("overall"))


def parse_score(text: Column) -> Column:
    """A judge's score: the first of 0.x, 1.0, 0 or 1 in its reply; .5 without one."""
    s = F.regexp_extract(text, r"(0\.\d+|1\.0|\b[01]\b)", 1)
    return F.when(F.coalesce(s, F.lit("")) == "", 0.5).otherwise(F.least(F.greatest(F.expr("0.0D") + s.cast("double"), F.lit(0.0)), F.lit(1.0)))
