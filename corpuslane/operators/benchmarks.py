"""Scoring of question-answering and entity benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions.text import word_set


def yes_no(text: Column) -> Column:
    """``yes`` or ``no`` as the text begins, else as the word occurs in it (yes first); null else."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.startswith("yes"), "yes").when(t.startswith("no"), "no").when(t.rlike(r"\byes\b"), "yes").when(t.rlike(r"\bno\b"), "no")
    )


def list_items(text: Column) -> Column:
    """Items of a list: of bullets, else of numbers, else the whole text; trimmed, blanks dropped."""
    bullets = F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-•*]\s*(.+)"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(r"\d+\.\s*(.+)"), F.lit(1))
    a = F.when(F.size(bullets) > 0, bullets).when(F.size(numbers) > 0, numbers).otherwise(F.array(text))
    return F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")


def list_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two lists as sets, case ignored; 0 if either is empty."""
    p, g = (F.array_distinct(F.transform(c, lambda x: F.lower(x))) for c in (predicted, gold))
    both = F.size(F.array_intersect(p, g))
    return F.when(both > 0, 2.0 * both / (F.size(p) + F.size(g))).otherwise(0.0)


def bioasq(rows: DataFrame) -> DataFrame:
    """(type, score, n) of (type, predicted, gold array): accuracy, share containing a gold answer, list F1, word-set Dice."""
    first = F.element_at("gold", 1)
    p, g = yes_no(F.col("predicted")), yes_no(first)
    a, b = word_set(F.col("predicted")), word_set(first)
    low = F.lower("predicted")
    score = (
        F.when(F.col("type") == "yesno", F.when(p.isNotNull() & g.isNotNull(), (p == g).cast("double")))
        .when(F.col("type") == "factoid", F.exists("gold", lambda x: F.contains(low, F.lower(x))).cast("double"))
        .when(F.col("type") == "list", list_f1(list_items(F.col("predicted")), F.col("gold")))
        .when(F.col("type") == "summary", F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))))
    )
    d = rows.where("predicted is not null and gold is not null and size(gold) > 0").withColumn("s", score)
    return d.groupBy("type").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("score"), F.count("s").alias("n"))


def answer_label(text: Column) -> Column:
    """``yes``, ``no`` or ``maybe`` of an answer: its beginning, else the word before a comma, stop or blank."""
    t = F.lower(text)
    return F.when(t.startswith("yes") | t.rlike(r"\byes[,. ]"), "yes").when(t.startswith("no") | t.rlike(r"\bno[,. ]"), "no").otherwise("maybe")


def label_accuracy(rows: DataFrame) -> DataFrame:
    """(label, accuracy, n) of (gold, predicted), per gold label and, as label ``all``, over all: one rollup."""
    d = rows.where("gold is not null").select(F.lower("gold").alias("gold"), F.coalesce("predicted", F.lit("maybe")).alias("predicted"))
    r = d.rollup("gold").agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"), F.grouping("gold").alias("g"))
    return r.select(F.when(F.col("g") == 1, "all").otherwise(F.col("gold")).alias("label"), "accuracy", "n")


def choice(text: Column) -> Column:
    """The first letter A to E that stands alone; A without one."""
    c = F.regexp_extract(text, r"\b([A-E])\b", 1)
    return F.when(F.coalesce(c, F.lit("")) == "", "A").otherwise(c)


def choice_accuracy(rows: DataFrame) -> DataFrame:
    """One row (accuracy, correct, n) of (predicted, gold)."""
    ok = F.upper(choice(F.col("predicted"))) == F.upper("gold")
    return rows.agg(F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("accuracy"), F.count_if(ok).alias("correct"), F.count("*").alias("n"))


# Gold types of the clinical entity benchmark.
GOLD_TYPES = {"problem": "DISEASE", "test": "LAB_VALUE", "treatment": "DRUG"}


def entity_prf(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) of entities (doc_id, text, type) as sets per document, case ignored.

    Predictions count once per document, text and type; gold entries count as often as they are given. Row
    ``all`` sums the types that were predicted or hit; ``micro_all`` sums all.
    """
    table = F.create_map(*[F.lit(x) for kv in GOLD_TYPES.items() for x in kv])
    g = gold.select("doc_id", F.lower("text").alias("t"), F.coalesce(table[F.lower("type")], F.upper("type")).alias("type"))
    g = g.groupBy("doc_id", "t", "type").agg(F.count("*").alias("times"))
    p = predicted.select("doc_id", F.lower("text").alias("t"), "type").distinct().withColumn("p", F.lit(1))
    j = g.join(p, ["doc_id", "t", "type"], "full_outer")
    c = j.groupBy("type").agg(
        F.sum(F.when(F.col("p").isNotNull(), F.coalesce("times", F.lit(0))).otherwise(0)).alias("tp"),
        F.count_if(F.col("times").isNull()).alias("fp"),
        F.sum(F.when(F.col("p").isNull(), F.col("times")).otherwise(0)).alias("fn"),
    )
    sums = [F.sum(x).alias(x) for x in ("tp", "fp", "fn")]
    some = c.where("tp + fp > 0").agg(*sums).select(F.lit("all").alias("type"), "tp", "fp", "fn")
    every = c.agg(*sums).select(F.lit("micro_all").alias("type"), "tp", "fp", "fn")
    d = c.unionByName(some).unionByName(every).na.fill(0, ["tp", "fp", "fn"])
    pr = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    re = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    d = d.withColumn("precision", pr).withColumn("recall", re)
    return d.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
