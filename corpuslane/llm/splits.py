"""Problem 7: train, validation and test splits that keep related records together.

Method: a Boruvka-style spanning forest joins records over shared entities; the components' roots are
stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.forest import dense_rank_by, spanning_forest
from corpuslane.session import materialize, small

#: Components of at least 1/BIG of all rows, of which there are at most BIG, are dealt one by one.
BIG = 1000
#: Length of the dealing pattern; shares are met to one in so many components.
PATTERN = 1000


def _valid(c: str):
    return F.col(c).isNotNull() & (F.col(c) != 0)


def _vertex(subject: str, admission: str, row: str):
    """A row's entity: its subject, else its admission, else itself. Null and 0 are no ids."""
    return (
        F.when(_valid(subject), F.concat(F.lit("s"), F.col(subject).cast("string")))
        .when(_valid(admission), F.concat(F.lit("h"), F.col(admission).cast("string")))
        .otherwise(F.concat(F.lit("r"), F.col(row).cast("string")))
    )


def entity_components(df: DataFrame, subject: str = "subject_id", admission: str = "hadm_id") -> tuple[DataFrame, DataFrame]:
    """(forest, labels) over the entities of ``df`` that share an admission, as :func:`spanning_forest` gives them.

    Entities are named ``s<subject>`` or, in rows without a subject, ``h<admission>``. Each admission
    ties all its entities to the smallest of them (a star), never all pairs of them.
    """
    pairs = df.where(_valid(admission)).select(F.col(admission).alias("h"), _vertex(subject, admission, admission).alias("v")).distinct()
    centre = pairs.groupBy("h").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a != z").select("h", "a")
    edges = pairs.join(centre, "h").select("a", F.col("v").alias("b"))
    return spanning_forest(edges, "splits")


def linked_subjects(df: DataFrame, subject: str = "subject_id", admission: str = "hadm_id") -> DataFrame:
    """All pairs (subject_a < subject_b) of different subjects in one component."""
    _, labels = entity_components(df, subject, admission)
    s = labels.where(F.col("v").startswith("s")).select("root", F.substring("v", 2, 40).cast("bigint").alias("s"))
    return (
        s.withColumnRenamed("s", "subject_a")
        .join(s.withColumnRenamed("s", "subject_b"), "root")
        .where("subject_a < subject_b")
        .select("subject_a", "subject_b")
    )


def dealing_pattern(shares: list[float], length: int = PATTERN) -> list[int]:
    """Split numbers, so that every prefix is as near to the shares as can be."""
    given, out = [0.0] * len(shares), []
    for i in range(1, length + 1):
        k = max(range(len(shares)), key=lambda j: (shares[j] * i - given[j], shares[j]))
        given[k] += 1
        out.append(k)
    return out


def assign_splits(
    df: DataFrame,
    shares: dict[str, float],
    row: str = "row_id",
    subject: str = "subject_id",
    admission: str = "hadm_id",
) -> DataFrame:
    """(row, ``component``, ``component_rows``, ``split``) for every row of ``df``.

    Rows tied by subject or admission, also through other rows, share a split; null and 0 tie nothing.
    ``shares`` are relative and count rows. Components of a thousandth of all rows or more (at most a
    thousand) are dealt one by one, largest first, to the split that lacks most; the others, in bands
    of doubling size, are dealt by a fixed pattern in hash order with shares that make up for the large
    ones. Deterministic; repeated rows stay; no rows give no rows; a single huge component takes one
    split, whatever the shares.
    """
    names, total_share = list(shares), sum(shares.values())
    part = [shares[k] / total_share for k in names]
    _, labels = entity_components(df, subject, admission)
    base = df.select(F.col(row).alias("_row"), _vertex(subject, admission, row).alias("v"))
    # labels hold only entities tied to others: broadcast if small, else joined by shuffle
    rows = base.join(small(labels, 64), "v", "left").select("_row", F.coalesce("root", "v").alias("component"))
    sizes = materialize(rows.groupBy("component").agg(F.count("*").alias("component_rows")), "component-sizes")
    total = sizes.agg(F.sum("component_rows")).first()[0] or 0
    large = sizes.where(F.col("component_rows") * BIG >= total).orderBy(F.desc("component_rows"), "component").collect()  # at most BIG rows
    got = [0.0] * len(names)
    fixed = []
    for r in large:
        k = max(range(len(names)), key=lambda j: (part[j] * total - got[j], part[j]))
        got[k] += r["component_rows"]
        fixed.append((r["component"], r["component_rows"], names[k]))
    lack = [max(0.0, part[j] * total - got[j]) for j in range(len(names))]
    rest = [x / sum(lack) for x in lack] if sum(lack) else part
    pattern = F.array(*[F.lit(names[k]) for k in dealing_pattern(rest)])
    many = sizes.where(F.col("component_rows") * BIG < total).withColumn("band", F.floor(F.log2("component_rows")))
    dealt = dense_rank_by(many, "band", ["component"]).select(
        "component", "component_rows", F.element_at(pattern, (F.col("rank0") % PATTERN + 1).cast("int")).alias("split")
    )
    spark = df.sparkSession
    head = spark.createDataFrame(fixed, "component string, component_rows bigint, split string")
    # a hot component's rows meet the broadcast head; the rest join by shuffle, each below 1/BIG of the rows
    first = rows.join(F.broadcast(head), "component", "left")
    done = first.where("split is not null")
    other = first.where("split is null").select("_row", "component").join(dealt, "component")
    return done.select("_row", "component", "component_rows", "split").unionByName(other).withColumnRenamed("_row", row)
