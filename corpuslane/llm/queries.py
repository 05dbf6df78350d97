"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.llm import cooccur, distinct_terms, leakage, mixture, names, neardup, pii, spam, split_items, splits
from corpuslane.session import table as _t


def _side_by_side(build: Callable[[str], DataFrame], names: tuple[str, ...]) -> list[DataFrame]:
    """The results of ``build`` for all names; the tables that they write on the way are written at the same time."""
    with ThreadPoolExecutor(len(names)) as pool:
        return list(pool.map(inheritable_thread_target(build), names))


# 1 -----------------------------------------------------------------------------------------------


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = (("clinical_notes", "row_id", "text"), ("pubmed_abstracts", "rec_id", "abstract"), ("chunks", "chunk_id", "text"))
    out = None
    for tbl, key, text in parts:
        src = _t(spark, d, tbl).select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("item_id"), F.col(text).alias("text"))
        one = split_items.split_oversized(src, "text")
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where((F.col("piece_index") == 0) & (F.col("n_pieces") > 1)).select("tbl", "item_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).drop("text")


def p1_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of an item cover its text without a gap, and each keeps the limit."""
    size = F.floor(F.regexp_count("piece", F.lit(split_items.WORD)) * F.lit(1.3))
    g = _pieces(spark, d).groupBy("tbl", "item_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_index", "char_start", "char_end"))).alias("p"), F.max(size).alias("most"), F.first(F.length("text")).alias("n")
    )
    covered = F.aggregate("p", F.lit(0), lambda at, x: F.when((x["char_start"] <= at) & (x["char_end"] > at), x["char_end"]).otherwise(-1))
    return g.select("tbl", "item_id", (covered == F.col("n")).alias("whole"), (F.col("most") <= 512).alias("within"))


# 2 -----------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str, least: int) -> DataFrame:
    p = _t(spark, d, "pubmed_abstracts")
    a, b = _side_by_side(lambda f: cooccur.cooccurrence(cooccur.record_items(p, "pmid", f), least).withColumn("field", F.lit(f)), ("mesh_terms", "keywords"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    strong = F.col("n_ab") * F.col("n") >= 4 * F.col("n_a") * F.col("n_b")
    return _pairs(spark, d, 5).where(strong).select("field", "item_a", "item_b")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, 1).select("field", "item_a", "item_b", "n_ab", F.round("lift", 6).alias("lift"), (F.round("llr", 4) + 0.0).alias("llr"))


# 3 -----------------------------------------------------------------------------------------------

#: TESTDATA.md: three-word sequences, half of them shared, 40 words at least.
P3 = neardup.NearDupParams(shingle=3, threshold=0.5, bands=48, rows=3)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "clinical_notes").select((F.col("row_id") * 2).alias("node"), "text")
    b = _t(spark, d, "pubmed_abstracts").select((F.col("rec_id") * 2 + 1).alias("node"), F.col("abstract").alias("text"))
    return a.unionByName(b)


def _named(c: str):
    return F.when(F.col(c).bitwiseAND(F.lit(1)) == 0, "clinical_notes").otherwise("pubmed_abstracts")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.all_pairs(neardup.near_duplicates(_texts(spark, d), P3))
    return pairs.select(_named("a").alias("tbl"), F.shiftright("a", 1).alias("id_a"), F.shiftright("b", 1).alias("id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    g = neardup.groups(neardup.near_duplicates(_texts(spark, d), P3, closed=False))
    return g.select(_named("node").alias("tbl"), *[F.shiftright(c, 1).alias(n) for c, n in (("node", "id"), ("class_id", "class_id"), ("rep", "copy_of"))])


# 4 -----------------------------------------------------------------------------------------------


def _variants(spark: SparkSession, d: str, field: str) -> DataFrame:
    used = names.spellings(_t(spark, d, "pubmed_abstracts"), field)
    return names.link_persons(used) if field == "authors" else names.link_journals(used)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, j = (names.variant_pairs(_variants(spark, d, f)).select(F.lit(f).alias("field"), "name_a", "name_b") for f in ("authors", "journal"))
    return a.unionByName(j)


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    a, j = (_variants(spark, d, f).select(F.lit(f).alias("field"), "name", "cluster") for f in ("authors", "journal"))
    return a.unionByName(j)


# 5 -----------------------------------------------------------------------------------------------


def _noted(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "clinical_notes").select(F.lit("clinical_notes").alias("tbl"), F.col("row_id").alias("item_id"), "text")
    b = _t(spark, d, "note_sections").select(F.lit("note_sections").alias("tbl"), F.col("section_id").alias("item_id"), "text")
    return a.unionByName(b)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.with_details(_noted(spark, d), "text").select("tbl", "item_id", F.explode("details").alias("x"))
    return found.select("tbl", "item_id", "x.kind", F.col("x.start_char").cast("bigint").alias("start_char"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_noted(spark, d), "text").select("tbl", "item_id", "redacted")


def p5_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether the text around the details, cut from the original, is what the redacted text holds around its placeholders."""
    x = pii.redact(pii.with_details(_noted(spark, d).where("text is not null"), "text", "found"), "text")
    ends = F.concat(F.array(F.lit(0)), F.transform("found", lambda k: k["end_char"]))
    starts = F.concat(F.transform("found", lambda k: k["start_char"]), F.array(F.length("text")))
    marks = F.concat(F.transform("found", lambda k: F.concat(F.lit("["), F.upper(k["kind"]), F.lit("]"))), F.array(F.lit("")))
    around = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    return x.select("tbl", "item_id", (F.array_join(F.zip_with(around, marks, lambda a, b: F.concat(a, b)), "") == F.col("redacted")).alias("whole"))


# 6 -----------------------------------------------------------------------------------------------

WINDOW = 4


def _chunk_terms(spark: SparkSession, d: str, keep=None) -> DataFrame:
    c = _t(spark, d, "chunks").where("chunk_id is not null")
    n = c.agg(F.count("*").alias("n_records"))
    return distinct_terms.distinctiveness(distinct_terms.term_graph_of_texts(c, "chunk_id", "text", WINDOW), n, keep)


def _mesh_terms(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pubmed_abstracts")
    e = p.where("pmid is not null").select("pmid", "rec_id", F.posexplode("mesh_terms").alias("pos", "x"))
    e = e.select("pmid", cooccur.mesh_item(F.col("x")).alias("item"), F.struct("rec_id", "pos").alias("at")).where("item != ''")
    first = e.groupBy("pmid", "item").agg(F.min("at").alias("at"))
    lists = first.groupBy("pmid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("items"))
    n = p.where("pmid is not null and mesh_terms is not null").select("pmid", F.explode("mesh_terms").alias("x"))
    n = n.where(cooccur.mesh_item(F.col("x")) != "").agg(F.countDistinct("pmid").alias("n_records"))
    return distinct_terms.distinctiveness(distinct_terms.term_graph_of_lists(lists, "pmid", "items", WINDOW), n)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    n, df, total = F.col("n").cast("double"), F.col("d").cast("double"), F.col("n_records").cast("double")
    # d >= 2 bounds the rarity, so no case is among the rows that this leaves out before the join
    possible = (1 + F.ln(n)) * F.ln(total / 2) >= 1.9 * F.ln(total) - 1e-9
    c = _chunk_terms(spark, d, possible).where((F.col("d") >= 2) & ((1 + F.ln(n)) * F.ln(total / df) >= 1.9 * F.ln(total)))
    m = _mesh_terms(spark, d).where((F.col("d") >= 2) & (df * df * df * df <= total))
    return c.select(F.lit("chunks").alias("tbl"), F.col("id").alias("item_id"), "term").unionByName(
        m.select(F.lit("pubmed_abstracts").alias("tbl"), F.col("id").alias("item_id"), "term")
    )


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "term", "n", "degree", "d", F.round("score", 6).alias("score")]
    return _chunk_terms(spark, d).select(F.lit("chunks").alias("tbl"), *cols).unionByName(
        _mesh_terms(spark, d).select(F.lit("pubmed_abstracts").alias("tbl"), *cols)
    )


# 7 -----------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_subjects(_t(spark, d, "clinical_notes"))


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_t(spark, d, "clinical_notes"), {"train": 0.8, "validation": 0.1, "test": 0.1})


def p7_together(spark: SparkSession, d: str) -> DataFrame:
    """How many subjects and stays are torn apart, and whether the shares are met within a twentieth."""
    x = p7_splits(spark, d).join(_t(spark, d, "clinical_notes").select("row_id", "subject_id", "hadm_id"), "row_id")
    torn = [x.where(f"{c} is not null and {c} != 0").groupBy(c).agg((F.min("split") != F.max("split")).alias("t")).agg(F.count_if("t").alias(n)) for c, n in (("subject_id", "torn_subjects"), ("hadm_id", "torn_stays"))]
    near = [F.abs(F.count_if(F.col("split") == k) / F.count("*") - v) <= 0.05 for k, v in (("train", 0.8), ("validation", 0.1), ("test", 0.1))]
    total = x.agg(F.count("*").alias("rows"), (near[0] & near[1] & near[2]).alias("shares_met"))
    return torn[0].join(torn[1]).join(total)  # one row each


# 8 -----------------------------------------------------------------------------------------------


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id", "words", F.explode("spans").alias("s")).select("doc_id", "item_id", "words", "s.start", "s.end")


# 9 -----------------------------------------------------------------------------------------------


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(_t(spark, d, "documents"), _t(spark, d, "mixture_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture_shares(_t(spark, d, "documents"), _t(spark, d, "mixture_targets"))


def p9_caps(spark: SparkSession, d: str) -> DataFrame:
    """Whether no row of a source is used more often than allowed."""
    return p9_shares(spark, d).select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


# 10 ----------------------------------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(_t(spark, d, "documents")).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p1_whole, p2_found, p2_pairs, p3_found, p3_groups, p4_found, p4_clusters, p5_found, p5_redacted, p5_whole, p6_found, p6_scores, p7_found, p7_splits, p7_together,
        p8_found, p8_spans, p9_mixture, p9_shares, p9_caps, p10_found,
    )
}
