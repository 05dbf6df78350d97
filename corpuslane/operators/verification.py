"""Claims of answers checked against passages: faithfulness, citations, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions.text import word_set
from corpuslane.operators.generation import DISCLAIMER


def strip_disclaimer(text: Column) -> Column:
    """The answer without the disclaimer and all that follows it."""
    return F.trim(F.regexp_replace(text, "(?s)(?:⚕|" + DISCLAIMER[:20] + ").*", ""))


def claims(answers: DataFrame, most: int = 20) -> DataFrame:
    """(answer_id, claim_id, claim) of (answer_id, text): sentences that state something.

    Sentences under 15 characters, notes, disclaimers, source lists and confidence lines are left out;
    claim_id is the sentence's place; the first ``most`` that remain are kept.
    """
    parts = F.transform(F.split(strip_disclaimer(F.col("text")), r"(?<=[.!?])\s+"), lambda s, i: F.struct(i.alias("claim_id"), F.trim(s).alias("claim")))

    def states(x: Column) -> Column:
        low = F.lower(x["claim"])
        head = low.startswith("note:") | low.startswith("disclaimer:") | low.startswith("sources:")
        return (F.length(x["claim"]) >= 15) & ~head & ~F.contains(low, F.lit("confidence level:"))

    e = answers.select("answer_id", F.explode(F.slice(F.filter(parts, states), 1, most)).alias("x"))
    return e.select("answer_id", "x.claim_id", "x.claim")


def claims_from_json(text: Column, most: int = 20) -> Column:
    """Claims in a model's reply: the strings of the JSON array between the first ``[`` and the last ``]``, blanks left out."""
    a = F.slice(F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>"), 1, most)
    return F.filter(a, lambda s: F.trim(s) != "")


def claims_from_replies(replies: DataFrame, most: int = 20) -> DataFrame:
    """(answer_id, claim_id, claim) of (answer_id, text, reply): the claims that a model listed in ``reply``, else, where it holds no list, those of :func:`claims`."""
    listed = replies.withColumn("_c", claims_from_json(F.col("reply"), most))
    asked = listed.where("_c is not null").select("answer_id", F.posexplode("_c").alias("claim_id", "claim"))
    return asked.unionByName(claims(listed.where("_c is null").select("answer_id", "text"), most))


#: Share of a claim's words in a passage from which it counts as entailed, and from which it counts as contradicted if negated.
ENTAILED, CONTRADICTED = 0.7, 0.5
_NEGATION = r"\b(?:no|not|never|without|neither|nor|denies|denied|kein|keine|nicht|ne|pas|sin|ninguna|ninguno)\b"


def lexical_entailment(claim: Column, passage: Column) -> Column:
    """Default three-way score: (entailment, contradiction, neutral) from the share of the claim's words in the passage and negations on one side only."""
    c = word_set(claim)
    share = F.when(F.size(c) > 0, F.size(F.array_intersect(c, word_set(passage))) / F.size(c)).otherwise(0.0)
    flipped = F.lower(claim).rlike(_NEGATION) != F.lower(passage).rlike(_NEGATION)
    return F.struct(
        F.when(flipped, 0.0).otherwise(share).alias("entailment"), F.when(flipped, share).otherwise(0.0).alias("contradiction"), (1 - share).alias("neutral")
    )


def verify(claim_rows: DataFrame, passages: DataFrame, scorer=lexical_entailment, threshold: float = ENTAILED) -> DataFrame:
    """(answer_id, claim_id, claim, label, score, passage_id): each claim against the passages (answer_id, passage_id, text) of its answer.

    The best entailing passage decides: entailment from ``threshold`` on; else contradiction if some passage
    contradicts by more than half; else neutral. Claims without passages are neutral with score 0.
    ``scorer`` is a function of two columns giving a struct of three shares.
    """
    j = claim_rows.join(passages.select("answer_id", "passage_id", F.col("text").alias("_p")), "answer_id", "left").withColumn("s", scorer(F.col("claim"), F.col("_p")))
    best = F.max(F.struct(F.round("s.entailment", 9).alias("e"), (-F.col("passage_id").cast("bigint")).alias("neg"), "_p"))
    g = j.groupBy("answer_id", "claim_id", "claim").agg(best.alias("b"), F.max("s.contradiction").alias("c"))
    label = F.when(F.col("b.e") >= threshold, "entailment").when(F.col("c") > CONTRADICTED, "contradiction").otherwise("neutral")
    score = F.when(F.col("b.e") >= threshold, F.col("b.e")).when(F.col("c") > CONTRADICTED, F.col("c")).otherwise(F.coalesce("b.e", F.lit(0.0)))
    return g.select(
        "answer_id", "claim_id", "claim", label.alias("label"), score.alias("score"),
        F.when(label == "entailment", -F.col("b.neg")).alias("passage_id"), F.when(label == "entailment", F.col("b._p")).alias("passage"),
    )


def faithfulness(verified: DataFrame, answers: DataFrame) -> DataFrame:
    """Per answer: claims, supported, contradicted, neutral, faithfulness, hallucination_rate, confidence. No claims: 1 and 0."""
    g = verified.groupBy("answer_id").agg(
        F.count("*").alias("claims"),
        *[F.count_if(F.col("label") == k).alias(n) for k, n in (("entailment", "supported"), ("contradiction", "contradicted"), ("neutral", "neutral"))],
        F.avg("score").alias("confidence"),
    )
    d = answers.select("answer_id").join(g, "answer_id", "left").na.fill(0, ["claims", "supported", "contradicted", "neutral"])
    f = F.when(F.col("claims") > 0, F.col("supported") / F.col("claims")).otherwise(1.0)
    return d.withColumn("faithfulness", f).withColumn("hallucination_rate", 1 - F.col("faithfulness"))


def blocked(report: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``report`` with ``blocked``: faithfulness below ``threshold``."""
    return report.withColumn("blocked", F.col("faithfulness") < threshold)


def citation_accuracy(answers: DataFrame, context: DataFrame, verified: DataFrame) -> DataFrame:
    """(answer_id, citations, supported, accuracy) of answers (answer_id, text) and context (answer_id, n, text).

    A ``[Doc N]``, counted as often as it stands, is supported if the beginning (50 characters) of some
    entailing passage of the answer occurs in document N. No citation: 1.
    """
    cites = answers.select("answer_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[Doc (\d+)\]"), F.lit(1))).alias("n"))
    cites = cites.select("answer_id", F.expr("try_cast(n as int)").alias("n")).groupBy("answer_id", "n").agg(F.count("*").alias("times"))
    proof = verified.where("label = 'entailment' and passage is not null and passage != ''").select("answer_id", F.substring("passage", 1, 50).alias("head")).distinct()
    good = context.join(proof, "answer_id").where(F.contains(F.col("text"), F.col("head"))).select("answer_id", "n").distinct().withColumn("ok", F.lit(1))
    s = cites.join(good, ["answer_id", "n"], "left").groupBy("answer_id").agg(F.sum("times").alias("citations"), F.sum(F.col("times") * F.coalesce("ok", F.lit(0))).alias("supported"))
    d = answers.select("answer_id").join(s, "answer_id", "left").na.fill(0, ["citations", "supported"])
    return d.withColumn("accuracy", F.when(F.col("citations") > 0, F.col("supported") / F.col("citations")).otherwise(1.0))


def self_consistency(claim_rows: DataFrame, samples: DataFrame, scorer=lexical_entailment, agreement: float = 0.67, threshold: float = ENTAILED) -> DataFrame:
    """(answer_id, claims, consistent, score): share of claims entailed by at least ``agreement`` of the answer's samples (answer_id, sample_id, text)."""
    j = claim_rows.join(samples.select("answer_id", "sample_id", F.col("text").alias("_p")), "answer_id", "left").withColumn("s", scorer(F.col("claim"), F.col("_p")))
    a = j.groupBy("answer_id", "claim_id").agg(F.avg(F.coalesce(F.col("s.entailment") >= threshold, F.lit(False)).cast("int")).alias("agree"))
    g = a.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(F.col("agree") >= agreement).alias("consistent"))
    return g.withColumn("score", F.col("consistent") / F.col("claims"))
