"""Connected components by Boruvka-style contraction, and rank without a global window.

Shared by the operators that group linked records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.session import BROADCAST_BYTES, materialize, release, small

#: Bytes of a pointer in memory, and of pointers that are broadcast.
POINTER_BYTES, LIMIT = 128, BROADCAST_BYTES
#: Each round at least halves the components that still have an edge, so 64 rounds cover any table.
MAX_ROUNDS = 64


#: Values that hold more than 1/HOT of a table's rows, of which there are fewer than HOT.
HOT = 1000


def _meet(df: DataFrame, key: str, pointers: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined to the written table ``pointers`` (key, one more column; each key once).

    Pointers that fit a broadcast are broadcast. Beyond, those of keys that hold many of the rows of ``df``,
    a bounded number, still are, and only the other rows are shuffled by key, so that no root that has
    gathered a large share of all rows makes one task of them.
    """
    hinted = small(pointers, POINTER_BYTES, LIMIT)
    if hinted is not pointers:
        return df.join(hinted, key, how)
    total = df.count()
    hot = materialize(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > total).select(key), "hot-roots")
    near = pointers.join(F.broadcast(hot), key, "left_semi")
    rows = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    frequent = rows.where("_hot").drop("_hot").join(F.broadcast(near), key, how)
    return frequent.unionByName(rows.where("_hot is null").drop("_hot").join(pointers, key, how))


def spanning_forest(edges: DataFrame, name: str = "forest") -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of the undirected graph ``edges`` (columns a, b of one type).

    Returns (forest, labels): forest has the chosen edges (a, b); labels has (v, root) for every vertex
    that has an edge to another one, root being a vertex of its component. Both are written tables.
    Nulls, loops and repeated edges are ignored; no edges give empty tables.

    Every round, each component picks its lightest edge (weight: hash of the contracted pair, ties by
    the pair), the picked edges are contracted by pointer jumping, and edges inside a component and
    all but the lightest of parallel ones are dropped. Picking is a ``min`` with map-side combine, so
    a hub's edges never gather in one task.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = (
        edges.where("a is not null and b is not null and a != b")
        .select(lo.alias("ra"), hi.alias("rb"))
        .distinct()
        .select("ra", "rb", F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    live = materialize(e, name + "-edges")
    labels = materialize(
        live.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root")), name + "-labels"
    )
    picked: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        w = F.struct(F.xxhash64("ra", "rb").alias("w"), "ra", "rb", "a", "b")
        light = (
            live.select(F.explode(F.array("ra", "rb")).alias("r"), w.alias("e"))
            .groupBy("r")
            .agg(F.min("e").alias("e"))
            .select("r", F.when(F.col("r") == F.col("e.ra"), F.col("e.rb")).otherwise(F.col("e.ra")).alias("p"), "e.a", "e.b")
        )
        choice = materialize(light, name + "-choice")
        picked.append(materialize(choice.select("a", "b").distinct(), name + "-picked"))
        # the lightest edge of a tree is picked from both sides; its smaller end becomes the root
        back = choice.select(F.col("r").alias("p"), F.col("p").alias("pp"))
        ptr = materialize(
            choice.join(back, "p").select("r", F.when((F.col("pp") == F.col("r")) & (F.col("r") < F.col("p")), F.col("r")).otherwise(F.col("p")).alias("p")),
            name + "-ptr",
        )
        release(choice)
        while True:
            up = ptr.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            far = materialize(_meet(ptr, "p", up).select("r", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), name + "-ptr")
            release(ptr)
            ptr = far.select("r", "p")
            ptr._scratch = far._scratch
            if far.where("moved").isEmpty():
                break
        new_labels = materialize(
            _meet(labels, "root", ptr.withColumnRenamed("r", "root"), "left").select("v", F.coalesce("p", "root").alias("root")), name + "-labels"
        )
        pa, pb = ptr.select(F.col("r").alias("ra"), F.col("p").alias("na")), ptr.select(F.col("r").alias("rb"), F.col("p").alias("nb"))
        nlo, nhi = F.least("na", "nb"), F.greatest("na", "nb")
        new_live = materialize(
            _meet(_meet(live, "ra", pa), "rb", pb)
            .where("na != nb")
            .groupBy(nlo.alias("ra"), nhi.alias("rb"))
            .agg(F.min(F.struct("a", "b")).alias("e"))
            .select("ra", "rb", "e.a", "e.b"),
            name + "-edges",
        )
        release(live, labels, ptr)
        live, labels = new_live, new_labels
    release(live)
    if not picked:
        return labels.select(F.col("v").alias("a"), F.col("v").alias("b")).where("false"), labels
    forest = picked[0]
    for x in picked[1:]:
        forest = forest.unionByName(x)
    return forest, labels


#: Cells of :func:`dense_rank_by`; each is a window of its own.
CELLS = 1024


def dense_rank_by(df: DataFrame, stratum: str, order: list) -> DataFrame:
    """``df`` with ``rank0``: 0, 1, 2, ... over strata in descending order and, within one, by a hash of ``order``.

    No window holds a whole stratum: rows are counted per cell of the hash, the counts (at most
    strata times ``CELLS`` rows) are summed up, and rows are numbered inside their cells.
    """
    h = df.withColumn("_h", F.xxhash64(*order)).withColumn("_cell", F.shiftright(F.col("_h"), 54) + CELLS // 2)
    counts = h.groupBy(stratum, "_cell").agg(F.count("*").alias("_n"))
    before = counts.select(
        stratum,
        "_cell",
        F.coalesce(
            F.sum("_n").over(Window.orderBy(F.desc(stratum), "_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = F.row_number().over(Window.partitionBy(stratum, "_cell").orderBy("_h", *order))
    return h.withColumn("_i", inside).join(before, [stratum, "_cell"]).withColumn("rank0", F.col("_before") + F.col("_i") - 1).drop(
        "_h", "_cell", "_i", "_before"
    )
