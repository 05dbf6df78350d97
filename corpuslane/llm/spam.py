"""Problem 10: keyword-stuffed and link-list pages.

Method: pages are cut into sentences and list-like blocks; the blocks' phrase shingles are exploded
and counted by distinct hosts over the whole collection; a page is flagged when most of its characters
lie in blocks that are stitched from replicated phrases or dense with links and tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.session import materialize

#: Words of a phrase shingle inside a block.
PHRASE = 3
#: Phrases in more than 1/HOT of all rows, of which there are at most HOT, join by broadcast.
HOT = 2000

_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"')\]”»]*\s+|\n+|<br\s*/?>|</p>", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?-i:[a-z]{2,})\b(?:\s*-\s*[^\n]{0,60}?(?=\s+[\w-]+\.[a-z]{3,}\b|\n|$))?",
    re.I | re.S,
)
_TAG = re.compile(r"(?<!\S)#[^\s#]+")
_PRODUCT = re.compile(r"\b(?:SKU|REF|ART|ITEM)[ #:-]?\w*\d\w*|[$€£]\s?\d+(?:[.,]\d{2})?|(?<![\d.,])\d{1,4}[.,]\d{2}(?:\s?[$€£])?(?=\s*(?:$|[/|;,\n]))", re.I | re.M)
_DOSE = re.compile(r"\b\d+(?:[.,]\d+)?\s?(?:mg|mcg|µg|μg|g|ml|iu|units?|mmol|meq|puffs?|tabs?|drops?)\b", re.I)
_REFERENCE = re.compile(r"^\s*(?:\[?\d{1,3}[\].)]\s).*(?:\b(?:19|20)\d\d\b|doi)", re.I)
_YEAR_PAGES = re.compile(r"\b(?:19|20)\d\d;\s?\d+(?:\(\d+\))?:\d+|\bdoi\b|10\.\d{4,}/", re.I)
_GLOSSARY = re.compile(r"^\s*[^\W\d_][^:=–\n]{0,40}\s?(?:[:=–]|\s-\s)\s?\S+(?:\s+\S+){2,}")
_FUNCTION = frozenset(
    # fixed values: frequent function words of English, French, German and Spanish
    """the of and in to was were is are with for by at after before than from that on as be not or we our who which
    le la les des du de et un une dans pour par sur avec est sont était au aux en que qui ou ce cette
    der die das den dem des und in im von zu mit auf bei für ist sind war wurden wurde nach aus ein eine einer zum
    el los las del y en con por para una un se que su al fue es son como más""".split()
)

#: What decides; see :func:`page_evidence`.
DENSE, VARIED, STITCHED = 0.5, 0.6, 0.75

_BLOCKS = "doc_id bigint, host string, n_chars int, chars int, dense double, variety double, phrases array<bigint>"


def _exempt(line: str) -> bool:
    """Whether a line belongs to a table, a reference list, a glossary or a medication list."""
    low = line.lower()
    listed = _may_link(line, low) and _LINK.search(line) or "#" in line and _TAG.search(line)
    if "\t" in line and not listed:
        return True
    if _REFERENCE.match(line) or _YEAR_PAGES.search(line):
        return True
    if listed or _may_sell(low) and _PRODUCT.search(line):
        return False
    return bool(_DOSE.search(line) or line.count(" - ") < 2 and _GLOSSARY.match(line))


_DOMAIN = re.compile(r"[\w-]\.[a-z]{2}")
_PRICE = re.compile(r"[$€£]|\d[.,]\d\d")


def _may_link(seg: str, low: str) -> bool:
    """False only where ``_LINK`` cannot match."""
    return "http" in low or "www." in low or "<a" in low or "](" in low or bool(_DOMAIN.search(seg))


def _may_sell(low: str) -> bool:
    """False only where ``_PRODUCT`` cannot match."""
    return "sku" in low or "ref" in low or "art" in low or "item" in low or bool(_PRICE.search(low))


def _sentence(seg: str) -> bool:
    """Whether a stretch without inner sentence ends reads like a sentence."""
    low = seg.lower()
    w = _WORD.findall(low)
    distinct = len(set(w))
    if _may_link(seg, low):
        if "http" in seg or "www." in seg:
            # a sentence that names a source
            own = _WORD.findall(_LINK.sub(" ", seg).lower())
            if len(own) >= 4 and seg.rstrip()[-1:] in ".!?…" and len(set(own)) >= 0.8 * len(own) and not _FUNCTION.isdisjoint(own):
                return True
        if _LINK.search(seg) and len(_LINK.sub("", seg)) < len(seg) / 2:
            return False
    if "#" in seg and len(_TAG.findall(seg)) * 3 > len(w) or _may_sell(low) and len(_PRODUCT.findall(seg)) * 8 > len(w):
        return False
    if seg.count("|") * 4 > len(w) or seg.count(";") * 5 > len(w) or seg.count("/") * 4 > len(w):
        return False
    if len(w) < 4 or distinct < 0.6 * len(w) and len(w) > 12:
        return False
    if len(w) > 80 and distinct < 0.5 * len(w):
        return False
    if seg.rstrip()[-1:] in ".!?…" and len(w) >= 5 and not _FUNCTION.isdisjoint(w):
        return True
    f = sum(x in _FUNCTION for x in w)
    # headlines have no stop at their end, but more words than entries of a list
    return len(w) >= 8 and f >= 0.12 * len(w) and distinct >= 0.7 * len(w)


def _split(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _SENTENCE_END.finditer(text):
        if m.end() > at:
            yield at, m.end()
            at = m.end()
    if at < len(text):
        yield at, len(text)


def list_blocks(text: str) -> list[tuple[int, float, float, list[int]]]:
    """The list-like blocks of a page: (characters, share in links and tags, distinct words per word, phrase hashes).

    Consecutive stretches that are no sentence and in no table, reference list, glossary or medication
    list make up a block.
    """
    out, run, begin = [], [], 0
    for a, b in [*_split(text), (len(text), len(text))]:
        seg = text[a:b]
        if a < b and seg.isspace():
            if run:
                run.append(seg)
            continue
        if a < b and not _sentence(seg) and not _exempt(seg):
            begin = begin if run else a
            run.append(seg)
            continue
        if not run:
            continue
        # a few words count if they fill their lines; inside a line they are a part of what stands around them
        whole = (begin == 0 or text[begin - 1] == "\n") and (a == len(text) or text[a - 1] == "\n")
        block = "".join(run).rstrip()
        run = []
        w = _WORD.findall(block.lower())
        if not w or len(w) < 6 and not whole:
            continue
        marked = sum(len(m.group()) for m in _LINK.finditer(block))
        rest = _LINK.sub(" ", block)
        marked += sum(len(m.group()) for m in _TAG.finditer(rest))
        rest = _TAG.sub(" ", rest)
        products = len(_PRODUCT.findall(rest))
        r = _WORD.findall(rest.lower())
        if products and len(r) <= products * 10:
            marked += len(rest.strip())
        if len(w) < 6 and marked < DENSE * len(block):
            continue  # a heading
        hashes = {xxhash.xxh3_64_intdigest(" ".join(w[i : i + PHRASE])) - (1 << 63) for i in range(max(1, len(w) - PHRASE + 1))}
        out.append((len(block), marked / len(block), len(set(w)) / len(w), list(hashes)))
    return out


def phrase_blocks(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per list-like block of each page; pages without one give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (i, h, len(t), *x)
                for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True)
                for x in list_blocks(t)
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
            names = ["doc_id", "host", "n_chars", "chars", "dense", "variety", "phrases"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    src = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text")
    )
    return src.mapInArrow(run, _BLOCKS)


def page_evidence(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, n_chars, list_chars, spam_chars, replicated, spam) for each page that has a list-like block.

    A block counts as spam if at least ``DENSE`` of it is links, tags and product items, or if it is
    stitched from phrases: its words vary little (distinct words at most ``VARIED`` of all) and the share of
    its words that repeat others plus the share of its phrases that occur on another host reach
    ``STITCHED``; or if the two kinds of evidence add up. A page is spam when more than half of its
    characters lie in spam blocks. Null and empty texts give no row, null hosts count as one host, and
    rows that repeat a doc_id are judged together.
    """
    b = phrase_blocks(docs, doc_id, text, host).withColumn("block", F.monotonically_increasing_id())
    b = materialize(b, "blocks")
    flat = b.select("doc_id", "block", F.xxhash64("host").alias("h"), F.explode("phrases").alias("phrase"))
    freq = materialize(
        flat.groupBy("phrase").agg(F.count("*").alias("rows"), (F.min("h") != F.max("h")).alias("elsewhere")),
        "phrase-hosts",
    )
    total = freq.agg(F.sum("rows")).first()[0] or 0
    hot = freq.where(F.col("rows") * HOT > total).select("phrase", "elsewhere")
    rest = freq.where(F.col("rows") * HOT <= total).select("phrase", "elsewhere")
    first = flat.join(F.broadcast(hot), "phrase", "left")
    known = first.where("elsewhere is not null").select("block", "elsewhere").unionByName(
        first.where("elsewhere is null").drop("elsewhere").join(rest, "phrase").select("block", "elsewhere")
    )
    share = known.groupBy("block").agg(F.avg(F.col("elsewhere").cast("int")).alias("replicated"))
    j = b.drop("phrases").join(share, "block")
    repeated = 1 - F.col("variety")
    stitched = (F.col("variety") <= VARIED) & (repeated + F.col("replicated") >= STITCHED)
    together = F.col("dense") / DENSE + repeated + F.col("replicated") >= 2
    j = j.withColumn("is_spam", (F.col("dense") >= DENSE) | stitched | together)
    return (
        j.groupBy("doc_id")
        .agg(
            F.max("n_chars").alias("n_chars"),
            F.sum("chars").alias("list_chars"),
            F.sum(F.when(F.col("is_spam"), F.col("chars")).otherwise(0)).alias("spam_chars"),
            F.avg("replicated").alias("replicated"),
        )
        .withColumn("spam", F.col("spam_chars") * 2 > F.col("n_chars"))
    )


def spam_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The pages that :func:`page_evidence` finds to be spam."""
    return page_evidence(docs, doc_id, text, host).where("spam")
