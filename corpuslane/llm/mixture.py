"""Problem 9: mix sources to target shares of all tokens, repeating documents a capped number of times.

Method: Poisson replication. Each document's count is the inverse of a Poisson distribution, whose
mean is its source's repetition rate, at a uniform number seeded by the document's hash; documents
are exploded by their counts and shuffled globally.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.session import materialize, release, small

#: Cells into which all sources' documents are sorted by their uniform numbers, at least ``LEAST_CELLS`` a source.
HISTOGRAM_ROWS, LEAST_CELLS = 200_000, 64
#: Bytes that a source's row of rates takes at most for each copy that its cap allows, and besides.
RATE_BYTES = 16


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE vocabulary in tiktoken's rank format, and its splitting pattern.

    ``path`` is the file; without one it is ``name`` in the folder that the variable TOKENIZERS names, else
    in the folder of the module ``public_tokenizers``, if one is installed. No vocabulary is shipped here.
    """

    path: str | None = None
    name: str = "byte_bpe_50k.tiktoken"
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def load(self):
        import tiktoken

        path = self.path
        if path is None and os.environ.get("TOKENIZERS"):
            path = os.path.join(os.environ["TOKENIZERS"], self.name)
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path(self.name))
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        return tiktoken.Encoding("corpus", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text, tokenizer: Tokenizer = Tokenizer()):
    """Column: number of tokens of ``text``; null for null."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer.load().encode_ordinary
        for s in batches:
            yield s.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return count(text)


def poisson_thresholds(rate: float, cap: int) -> list[float]:
    """Cumulative probabilities P(X <= k), k = 0 .. cap - 1, of a Poisson variable: u above k of them means k + 1 or more copies."""
    if math.isinf(rate):
        return [-1.0] * cap
    if rate <= 0:
        return [2.0] * cap
    out, total = [], 0.0
    for k in range(cap):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
    return out


def fit_rate(u: np.ndarray, weight: np.ndarray, cap: int, goal: float) -> float:
    """The mean at which the documents' counts (at most ``cap`` each) sum up to ``goal`` tokens; inf when all caps are needed."""
    full = float(weight.sum()) * cap
    if goal >= full * (1 - 1e-9):
        return math.inf
    if goal <= 0:
        return 0.0

    def reached(rate: float) -> float:
        return float(sum(weight[u > t].sum() for t in poisson_thresholds(rate, cap)))

    lo, hi = -20.0, math.log(cap * 4 + 60)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if reached(math.exp(mid)) < goal else (lo, mid)
    a, b = reached(math.exp(lo)), reached(math.exp(hi))
    return math.exp(lo if abs(a - goal) <= abs(b - goal) else hi)


@dataclass
class Plan:
    """Fitted mixture. ``rates``: per target source its share, its share among the sources that have text, cap, size, rate and thresholds."""

    rates: DataFrame
    sizes: DataFrame

    def table(self) -> DataFrame:
        return self.rates


_RATES = "source string, target_share double, share_with_text double, max_repeats int, docs bigint, tokens bigint, rate double, thresholds array<double>"


def _u(doc_id: str, seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed)), 11) / F.lit(float(1 << 53))


def plan_mixture(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: float | None = None, tokenizer: Tokenizer = Tokenizer(), seed: int = 17,
) -> Plan:
    """Measure the sources and fit a rate to each.

    Without ``total_tokens`` the sample is as large as the caps allow with every share met. With it, a
    source whose cap is too low for its share is repeated up to its cap and reported below its target.
    Sources without a target, or null, take no part; a target without documents cannot be met, and the
    others keep their proportions. Targets with null or no share or cap count as 0; of a source that is
    named twice the larger share and cap count. There may be any number of sources: each is fitted in a
    task of its own from a histogram of its documents, nothing but the total comes to the driver.
    """
    want = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.greatest(F.max(F.coalesce("target_share", F.lit(0.0))), F.lit(0.0)).alias("share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(0))), F.lit(0)).cast("int").alias("cap"))
    )
    want = materialize(want, "targets")
    named = want.agg(F.count("*").alias("n"), F.max("cap").alias("cap")).first()
    sizes = materialize(
        docs.where(F.col(text).isNotNull())
        .select(F.col(source).alias("source"), _u(doc_id, seed).alias("u"), F.col(text).alias("t"))
        .join(small(want.select("source"), 64), "source")
        .select("source", "u", token_count(F.col("t"), tokenizer).alias("tokens"))
        .where("tokens > 0"),
        "sizes",
    )
    bins = max(LEAST_CELLS, HISTOGRAM_ROWS // max(1, named["n"]))
    cells = materialize(
        sizes.groupBy("source", F.floor(F.col("u") * bins).alias("bin")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.avg("u").alias("u")), "size-cells"
    )
    held = cells.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("all_tokens"))
    held = want.join(held, "source", "left").withColumn("there", (F.coalesce("all_tokens", F.lit(0)) > 0) & (F.col("share") > 0) & (F.col("cap") > 0))
    sums = held.where("there").agg(F.sum("share").alias("whole"), F.min(F.col("all_tokens") * F.col("cap") / F.col("share")).alias("least")).first()
    whole = sums["whole"] or 1.0
    total = (sums["least"] or 0.0) * whole if total_tokens is None else float(total_tokens)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        share = r.share / whole if r.there else 0.0
        rate = fit_rate(part.u.to_numpy(float), part.tokens.to_numpy(float), int(r.cap), total * share) if r.there else 0.0
        n, t = (int(part.docs.sum()), int(part.tokens.sum())) if not math.isnan(part.tokens.sum()) else (0, 0)
        row = (r.source, float(r.share), float(share), int(r.cap), n, t, rate, poisson_thresholds(rate, int(r.cap)))
        return pd.DataFrame([row], columns=["source", "target_share", "share_with_text", "max_repeats", "docs", "tokens", "rate", "thresholds"])

    joined = held.select("source", "share", "cap", "there").join(cells.select("source", "u", "docs", "tokens"), "source", "left").na.fill({"docs": 0, "tokens": 0, "u": 0.0})
    rates = materialize(joined.groupBy("source").applyInPandas(fit, _RATES), "rates")
    release(want, cells)
    rates = small(rates, 64 + RATE_BYTES * (1 + (named["cap"] or 0)))
    return Plan(rates, sizes)


def _copies():
    return F.size(F.filter("thresholds", lambda t: F.col("u") > t))


def mixture(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: float | None = None, tokenizer: Tokenizer = Tokenizer(), seed: int = 17,
) -> DataFrame:
    """The sample: one row per copy with all columns of ``docs`` and ``copy`` (from 1), ``n_tokens``, ``shuffle_key``.

    Columns of ``docs`` under these names are replaced. Rows come in random order: they are spread over
    the partitions, and ordered within them, by a hash of document and copy. Null and empty texts and
    rows without a targeted source are not sampled. Rows that repeat a doc_id get equal counts. The
    result is the same in every run with one seed.
    """
    plan = plan_mixture(docs, targets, doc_id, text, source, total_tokens, tokenizer, seed)
    new = ("copy", "n_tokens", "shuffle_key", "thresholds", "u")
    cols = [c for c in docs.columns if c not in new or c in (doc_id, text, source)]
    rates = plan.table().select(F.col("source").alias("_source"), "thresholds")
    picked = (
        docs.where(F.col(text).isNotNull() & (F.col(text) != ""))
        .select(*[F.col(f"`{c}`") for c in cols], _u(doc_id, seed).alias("u"))
        .join(rates, F.col(f"`{source}`") == F.col("_source"))
        .withColumn("_n", _copies())
        .where("_n > 0")
        .withColumn("n_tokens", token_count(F.col(text), tokenizer))
        .select(*[F.col(f"`{c}`") for c in cols], "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    )
    return picked.withColumn("shuffle_key", F.xxhash64(F.col(doc_id), F.col("copy"), F.lit(seed + 1))).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixture_shares(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: float | None = None, tokenizer: Tokenizer = Tokenizer(), seed: int = 17,
) -> DataFrame:
    """The report: per target source what it holds, its rate, the tokens and share it reaches, and its most used copies."""
    plan = plan_mixture(docs, targets, doc_id, text, source, total_tokens, tokenizer, seed)
    rates = plan.table()
    reached = (
        plan.sizes.join(rates.select("source", "thresholds"), "source")
        .withColumn("n", _copies())
        .groupBy("source")
        .agg(F.sum(F.col("n") * F.col("tokens")).alias("reached_tokens"), F.max("n").alias("most_copies"), F.sum("n").alias("rows_out"))
    )
    total = reached.agg(F.sum("reached_tokens").alias("all_tokens"))
    return (
        rates.drop("thresholds")
        .join(reached, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            "source", "target_share", "share_with_text", "max_repeats", "docs", "tokens", "rate",
            F.coalesce("rows_out", F.lit(0)).alias("rows_out"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
            F.coalesce(F.col("reached_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
        )
    )
