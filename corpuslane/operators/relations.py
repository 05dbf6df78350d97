"""Relations between entities by patterns: drug interactions, adverse reactions, genes and diseases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions.text import match_spans, sentences_plain

_W2 = r"[\p{L}\p{N}_]+(?:\s+[\p{L}\p{N}_]+)?"
_W5 = r"[\p{L}\p{N}_]+(?:\s+[\p{L}\p{N}_]+){1,4}"
_GENE = r"[A-Z][A-Z0-9]+(?:\d+)?"

# Fixed values: (pattern, group of the subject, group of the object, kind, confidence). Case is ignored.
# The last part of a rule is ours: what a text must hold for the pattern to match, searched first as it is cheap.
DDI = (
    (rf"({_W2})\s+(?:significantly\s+)?(?:increases?|decreases?|reduces?|elevates?|lowers?)\s+(?:plasma\s+)?(?:levels?|concentrations?)\s+of\s+({_W2})", 1, 2, "mechanism", 0.70, "level|concentration"),
    (rf"({_W2})\s+(?:and|with)\s+({_W2})\s+(?:may\s+)?(?:increase|decrease|cause)\s+(?:[\p{{L}}\p{{N}}_]+\s+)?risk", 1, 2, "effect", 0.70, "risk"),
    (rf"(?:do\s+not\s+use|avoid\s+combining?|contraindicated)\s+({_W2})\s+(?:with|and)\s+({_W2})", 1, 2, "advise", 0.70, "use|avoid|contraindicated"),
)
ADR = (
    (rf"({_W2})\s+(?:may\s+)?(?:cause[sd]?|induce[sd]?|result(?:ed)?\s+in|lead[s]?\s+to|associated\s+with)\s+({_W2})", 1, 2, "causes", 0.75, "cause|induce|result|lead|associated"),
    (rf"({_W2})\s+(?:was|were|has\s+been)\s+(?:reported|observed|noted)\s+(?:in\s+patients\s+)?(?:receiving|taking|treated\s+with)\s+({_W2})", 2, 1, "reported", 0.70, "receiving|taking|treated"),
    (rf"side\s+effects?\s+(?:of|associated\s+with)\s+({_W2}):\s+([^.;]+)", 1, 2, "side_effect", 0.65, "side"),
)
GENE_DISEASE = (
    (rf"({_GENE})\s+(?:mutations?\s+)?(?:are|is)\s+(?:associated\s+with|linked\s+to|implicated\s+in)\s+({_W5})", 1, 2, "associated", 0.75, "associated|linked|implicated"),
    (rf"({_GENE})\s+(?:gene\s+)?(?:mutations?|variants?|alterations?)\s+(?:cause|result\s+in|lead\s+to)\s+({_W5})", 1, 2, "variant", 0.80, "mutation|variant|alteration"),
    (rf"({_W5})\s+(?:is|are)\s+caused\s+by\s+(?:mutations?\s+in\s+)?({_GENE})", 2, 1, "caused_by", 0.80, "caused"),
)

_NEGATED = r"(?i)\b(?:no|not|without|negative for|denies?)\b"
_SPECULATIVE = r"(?i)\b(?:may|might|could|possibly|potentially|suspected)\b"


def _matches(docs: DataFrame, rules: tuple, strict_case: bool = False) -> DataFrame:
    """One row per match: (doc_id, text, rule, start, end, subject, object, kind, confidence)."""
    out = None
    for i, (p, s, o, kind, conf, needs) in enumerate(rules):
        rx = p if strict_case else "(?i)" + p
        t = F.col("text")
        parts = F.arrays_zip(
            match_spans(t, rx).alias("m"), F.regexp_extract_all(t, F.lit(rx), F.lit(s)).alias("s"), F.regexp_extract_all(t, F.lit(rx), F.lit(o)).alias("o")
        )
        d = docs.where(F.col("text").rlike("(?i)" + needs) & F.col("text").rlike(rx)).select("doc_id", "text", F.explode(parts).alias("x"))
        d = d.select(
            "doc_id", "text", F.lit(i).alias("rule"), F.col("x.m.start").alias("start"), F.col("x.m.end").alias("end"),
            F.trim("x.s").alias("subject"), F.trim("x.o").alias("object"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"),
        )
        out = d if out is None else out.unionByName(d)
    return out


def _around(n: int) -> Column:
    a = F.greatest(F.col("start") - n, F.lit(0))
    return F.substring("text", a + 1, F.col("end") + n - a)


def drug_interactions(docs: DataFrame) -> DataFrame:
    """Interactions in (doc_id, text): of equal pairs (case ignored) and kind within a document the first is kept."""
    m = _matches(docs, DDI).withColumn("evidence", _around(50))
    w = Window.partitionBy("doc_id", F.lower("subject"), F.lower("object"), "kind").orderBy(F.desc("confidence"), "rule", "start")
    return m.withColumn("i", F.row_number().over(w)).where("i = 1").select("doc_id", "subject", "object", "kind", "confidence", "evidence", "start")


def adverse_reactions(docs: DataFrame, least: float = 0.6, negated: bool = False) -> DataFrame:
    """Reactions in (doc_id, text), every match: a cue of negation in the 30 characters before it leaves it out unless ``negated``; a cue of doubt inside it takes a fifth of its confidence."""
    m = _matches(docs, ADR)
    a = F.greatest(F.col("start") - 30, F.lit(0))
    m = m.withColumn("negated", F.substring("text", a + 1, F.col("start") - a).rlike(_NEGATED))
    inside = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    m = m.withColumn("speculative", inside.rlike(_SPECULATIVE)).withColumn("confidence", F.col("confidence") * F.when(F.col("speculative"), 0.8).otherwise(1.0))
    before = F.substring("text", F.lit(1), F.col("start"))
    begin = F.length(before) - F.length(F.substring_index(before, ".", -1))
    stop = F.expr("locate('.', text, `end` + 1)")
    evidence = F.when(stop > 0, F.trim(F.substring("text", begin + 1, stop - begin))).otherwise(inside)
    m = m.withColumn("evidence", evidence).where(F.col("confidence") >= least)
    m = m if negated else m.where(~F.col("negated"))
    return m.select("doc_id", "subject", "object", "kind", "confidence", "negated", "speculative", "evidence", "start")


def gene_diseases(docs: DataFrame, least: float = 0.6, strict_gene: bool = False) -> DataFrame:
    """Gene-disease relations in (doc_id, text), every match. Case is ignored, so that any word may be a gene, unless ``strict_gene``."""
    m = _matches(docs, GENE_DISEASE, strict_gene).withColumn("evidence", F.trim(_around(20)))
    return m.where(F.col("confidence") >= least).select("doc_id", "subject", "object", "kind", "confidence", "evidence", "start")


def entity_pairs(docs: DataFrame, entities: DataFrame, a: str = "DRUG", b: str = "DRUG") -> DataFrame:
    """Pairs of entities of two types in one sentence, marked up for a relation classifier: (doc_id, sentence, first, second, marked).

    Sentences are found in (doc_id, text); entities (doc_id, type, text) belong to a sentence that contains
    their text. Within a type the first is the one that stands earlier.
    """
    s = docs.where("text is not null").select("doc_id", F.posexplode(sentences_plain(F.col("text"))).alias("pos", "sentence"))
    names = entities.select("doc_id", "type", "text").distinct()
    j = s.join(names, "doc_id").where(F.contains(F.col("sentence"), F.col("text"))).withColumn("at", F.instr(F.col("sentence"), F.col("text")))
    x = j.where(F.col("type") == a).select("doc_id", "pos", "sentence", F.col("text").alias("first"), F.col("at").alias("at1"))
    y = j.where(F.col("type") == b).select("doc_id", "pos", F.col("text").alias("second"), F.col("at").alias("at2"))
    p = x.join(y, ["doc_id", "pos"]).where((F.col("at1") < F.col("at2")) if a == b else (F.col("first") != F.col("second")))
    marked = F.replace(F.replace(F.col("sentence"), F.col("first"), F.lit("[DRUG1]")), F.col("second"), F.lit("[DRUG2]"))
    return p.select("doc_id", "pos", "sentence", "first", "second", marked.alias("marked"))


def classify_pairs(pairs: DataFrame, model: Callable[[list[str]], list[tuple[str, float]]], least: float = 0.5, none: str = "negative", batch: int = 32) -> DataFrame:
    """Relations (doc_id, subject, object, kind, confidence, evidence) that a classifier of marked sentences finds in :func:`entity_pairs`.

    ``model`` maps marked sentences to (kind, confidence), ``batch`` at a time; the kind ``none`` and those
    under ``least`` are left out.
    """

    @F.arrow_udf("struct<kind:string,confidence:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = [t or "" for t in b.to_pylist()]
            found = [x for k in range(0, len(texts), batch) for x in model(texts[k : k + batch])]
            yield pa.array([{"kind": k, "confidence": float(c)} for k, c in found], pa.struct([("kind", pa.string()), ("confidence", pa.float64())]))

    d = pairs.withColumn("_r", run.asNondeterministic()(F.col("marked"))).where((F.col("_r.kind") != none) & (F.col("_r.confidence") >= least))
    return d.select("doc_id", F.col("first").alias("subject"), F.col("second").alias("object"), "_r.kind", "_r.confidence", F.col("sentence").alias("evidence"))


def all_relations(docs: DataFrame) -> DataFrame:
    """Relations of the three extractors: (relation, doc_id, subject, object, kind, confidence, evidence)."""
    cols = ["doc_id", "subject", "object", "kind", "confidence", "evidence"]
    parts = (("drug_interaction", drug_interactions(docs)), ("adverse_reaction", adverse_reactions(docs)), ("gene_disease", gene_diseases(docs)))
    out = None
    for name, d in parts:
        one = d.select(F.lit(name).alias("relation"), *cols)
        out = one if out is None else out.unionByName(one)
    return out


def graph_edges(relations: DataFrame) -> DataFrame:
    """Edges of the relation graph: (relation, subject, object in lower case, n, docs, confidence)."""
    return relations.groupBy("relation", F.lower("subject").alias("subject"), F.lower("object").alias("object")).agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("confidence").alias("confidence")
    )
