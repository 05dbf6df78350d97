"""Named entities: a gazetteer tagger, model adapters, overlap resolution, groupings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Entity types, and the labels of tagging models that map to them; they have to be these for equal types.
ENTITY_TYPES = ("DISEASE", "DRUG", "GENE", "PROTEIN", "CHEMICAL", "SPECIES", "MUTATION", "CELL_LINE", "ANATOMY", "PROCEDURE", "LAB_VALUE")
LABEL_MAP = {
    "DISEASE": "DISEASE", "CHEMICAL": "DRUG", "DRUG": "DRUG", "GENE_OR_GENE_PRODUCT": "GENE", "PROTEIN": "PROTEIN", "DNA": "GENE", "RNA": "GENE",
    "CELL_LINE": "CELL_LINE", "CELL_TYPE": "ANATOMY", "ORGANISM": "SPECIES", "MUTATION": "MUTATION", "GENE": "GENE", "AMINO_ACID": "PROTEIN",
    "CANCER": "DISEASE", "ORGAN": "ANATOMY", "TISSUE": "ANATOMY", "ENTITY": "DISEASE",
}

#: Bytes of dictionary that are sent to the tasks.
DICTIONARY_BYTES = 8 << 20
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")


def entity_type(label: Column) -> Column:
    """A model's label as an entity type; unknown labels stay."""
    table = F.create_map(*[F.lit(x) for kv in LABEL_MAP.items() for x in kv])
    return F.coalesce(table[F.upper(label)], F.upper(label))


class _Bits:
    """A Bloom filter with two hashes per run, ``DICTIONARY_BYTES`` large."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(run: str, n: int) -> tuple[int, int]:
        d = hashlib.blake2b(run.encode(), digest_size=16).digest()
        return int.from_bytes(d[:8], "little") % n, int.from_bytes(d[8:], "little") % n

    def __contains__(self, run: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(run, len(self.bits) * 8))


def _filter(terms: DataFrame) -> _Bits:
    """The filter of all runs; at most eight tasks build a part each, which are joined on the driver."""
    size = DICTIONARY_BYTES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for run in b.column(0).to_pylist():
                for p in _Bits.places(run, size * 8):
                    bits[p >> 3] |= 1 << (p & 7)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size, np.uint8)
    for r in terms.select("run").repartition(8).mapInArrow(part, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return _Bits(out)


def gazetteer(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, type, text, start, end, confidence): dictionary terms (term, type) in (doc_id, text), case ignored.

    A term matches where its words stand one after the other with single spaces between them. Each text
    gives its runs of as many words as some term has; runs meet the dictionary by an equality join on
    the lower-cased run, of any size. A dictionary of up to ``DICTIONARY_BYTES`` is also sent to the
    tasks, which then send on only runs that are in it; of a larger one they get a filter of that size,
    which lets some other runs pass, too. Overlaps are left in; see :func:`resolve_overlaps`. Null texts,
    null terms and repeated terms add nothing.
    """
    t = terms.where("term is not null and type is not null").select(F.lower(F.trim("term")).alias("run"), "type").where("run != ''").distinct()
    words = F.regexp_extract_all("run", F.lit(r"[^\s]+"), F.lit(0))
    size = t.agg(F.max(F.size(words)).alias("longest"), F.sum(F.octet_length("run") + 64).alias("bytes")).first()
    longest = size["longest"] or 0
    known = None
    if (size["bytes"] or 0) <= DICTIONARY_BYTES:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r["run"] for r in t.select("run").distinct().collect()))
    elif DICTIONARY_BYTES:
        known = docs.sparkSession.sparkContext.broadcast(_filter(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value if known is not None else None
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = [m.span() for m in _WORD.finditer(text)]
                low = text.lower()
                same = len(low) == len(text)
                for i, (a, _) in enumerate(spans):
                    for k in range(i, min(i + longest, len(spans))):
                        if k > i and text[spans[k - 1][1] : spans[k][0]] != " ":
                            break
                        e = spans[k][1]
                        r = low[a:e] if same else text[a:e].lower()
                        if keep is None or r in keep:
                            out.append((doc, r, text[a:e], a, e))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (b.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "run", "text", "start", "end"])

    d = docs.where("text is not null").select("doc_id", "text")
    kind = dict(d.dtypes)["doc_id"]
    runs = d.mapInArrow(run, f"doc_id {kind}, run string, text string, `start` int, `end` int")
    return runs.join(t, "run").select("doc_id", "type", "text", "start", "end", F.lit(1.0).alias("confidence"))


def tag(docs: DataFrame, model: Callable[[list[str]], list[list[tuple[str, str, int, int, float]]]], batch: int = 64, failed: bool = False) -> DataFrame:
    """Entities of a model that maps texts to lists of (text, label, start, end, confidence), ``batch`` texts at a time.

    If a call fails, its texts are tried one by one; a text on which the model fails alone gives no entities
    or, with ``failed``, one row of type ``FAILED`` with a null text, so that failures can be counted
    (:func:`failures`).
    """
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
    names = ("text", "label", "start", "end", "confidence")

    def ask(texts: list[str]) -> list[list[tuple]]:
        try:
            found = model(texts)
            if len(found) == len(texts):
                return found
        except Exception:
            if len(texts) == 1:
                return [[(None, "FAILED", None, None, None)]]
        return [x for t in texts for x in ask([t])] if len(texts) > 1 else [[(None, "FAILED", None, None, None)]]

    @F.arrow_udf("array<struct<text:string,label:string,start:int,end:int,confidence:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = [t or "" for t in b.to_pylist()]
            found = [x for k in range(0, len(texts), batch) for x in ask(texts[k : k + batch])]
            yield pa.array([[dict(zip(names, x, strict=True)) for x in f] for f in found], kind)

    # the failures leave after the model ran: it is not asked again
    e = docs.select("doc_id", run.asNondeterministic()(F.col("text")).alias("_found")).select("doc_id", F.explode("_found").alias("x"))
    e = e if failed else e.where("x.label != 'FAILED'")
    return e.select("doc_id", entity_type(F.col("x.label")).alias("type"), "x.text", "x.start", "x.end", "x.confidence")


def failures(entities: DataFrame) -> DataFrame:
    """One row (failed): texts on which a model of :func:`tag` failed."""
    return entities.agg(F.count_if(F.col("type") == "FAILED").alias("failed"))


def link(entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """Entities with ``concept_id`` and ``concept_name`` of a table (name, concept_id, canonical, score): the best score of an equal name, case ignored, ties by id; else null."""
    best = concepts.where("name is not null").groupBy(F.lower(F.trim("name")).alias("_n")).agg(
        F.max_by(F.struct("concept_id", "canonical"), F.struct("score", F.col("concept_id").cast("string"))).alias("_c")
    )
    j = entities.withColumn("_n", F.lower(F.trim("text"))).join(best, "_n", "left")
    return j.select(*[F.col(f"`{c}`") for c in entities.columns if c not in ("concept_id", "concept_name")], F.col("_c.concept_id").alias("concept_id"), F.col("_c.canonical").alias("concept_name"))


def align_tags(tags: Column, word_of: Column, label_all: bool = False) -> Column:
    """BIO tags of words as tags of sub-words; ``word_of`` holds each sub-word's word (from 0), null for special tokens.

    A word's first sub-word takes its tag; the later ones are null (left out of a loss) or, with
    ``label_all``, the tag with ``I-`` for ``B-``. Special tokens are null.
    """
    first = F.transform(word_of, lambda w, i: w.isNotNull() & ((i == 0) | ~w.eqNullSafe(F.get(word_of, i - 1))))
    tag_of = F.transform(word_of, lambda w: F.when(w.isNotNull(), F.get(tags, w)))
    rest = F.transform(tag_of, lambda t: F.regexp_replace(t, "^B-", "I-")) if label_all else F.transform(tag_of, lambda t: F.lit(None).cast("string"))
    return F.transform(F.arrays_zip(first.alias("f"), tag_of.alias("t"), rest.alias("r")), lambda x: F.when(x["f"], x["t"]).otherwise(x["r"]))


def ensemble(parts: list[DataFrame], least: float = 0.5) -> DataFrame:
    """Entities of several taggers of at least ``least`` confidence, overlaps resolved."""
    out = parts[0].withColumn("source", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("source", F.lit(i)))
    return resolve_overlaps(out.where(F.col("confidence") >= least))


def resolve_overlaps(entities: DataFrame) -> DataFrame:
    """Of overlapping entities of a document the more confident ones; ties go to the earlier source, start, longer span, then type.

    A document's entities are folded in that order; one is kept if it overlaps none that was kept.
    """
    src = F.col("source") if "source" in entities.columns else F.lit(0)
    x = F.struct((-F.col("confidence")).alias("neg"), src.alias("src"), F.col("start").cast("int").alias("start"), (-F.col("end")).cast("int").alias("nend"), "type", "text")
    g = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(x)).alias("all"))
    kind = "array<struct<neg:double,src:int,start:int,nend:int,type:string,text:string>>"
    kept = F.aggregate(
        F.col("all").cast(kind), F.array().cast(kind),
        lambda a, e: F.when(F.exists(a, lambda k: (k["start"] < -e["nend"]) & (e["start"] < -k["nend"])), a).otherwise(F.concat(a, F.array(e))),
    )
    e = g.select("doc_id", F.explode(kept).alias("e"))
    return e.select("doc_id", "e.type", "e.text", "e.start", (-F.col("e.nend")).alias("end"), (-F.col("e.neg")).alias("confidence"))


def by_type(entities: DataFrame) -> DataFrame:
    """(doc_id, type, texts): distinct texts per document and type in the order in which they appear."""
    first = entities.groupBy("doc_id", "type", "text").agg(F.min("start").alias("start"))
    g = first.groupBy("doc_id", "type").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("x"))
    return g.select("doc_id", "type", F.transform("x", lambda y: y["text"]).alias("texts"))


def type_counts(entities: DataFrame) -> DataFrame:
    """(type, n)."""
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def bio_spans(tokens: DataFrame) -> DataFrame:
    """Spans of tagged tokens (doc_id, pos, token, tag in BIO form): (doc_id, first, last, type, text).

    A span begins at a ``B-`` tag and takes the ``I-`` tags of its type after it; an ``I-`` tag that
    follows no such span begins one, too.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    kind = F.substring("tag", 3, 100)
    before = F.lag("tag").over(w)
    fresh = F.col("tag").startswith("B-") | (F.col("tag").startswith("I-") & ~F.coalesce((before != "O") & (F.substring(before, 3, 100) == kind), F.lit(False)))
    d = tokens.withColumn("span", F.sum(F.when(fresh, 1).otherwise(0)).over(w)).where("tag != 'O'").withColumn("type", kind)
    g = d.groupBy("doc_id", "span", "type").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return g.select("doc_id", "first", "last", "type", F.array_join(F.transform("x", lambda y: y["token"]), " ").alias("text"))
