"""Dense retrieval: exact search in query blocks, an inverted-file index, hyperplane hashing, metadata filters."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that travel to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: Most rows on which the cells of an inverted file are fitted.
FIT_ROWS = 50_000


def metadata_filter(conditions: dict[str, object]) -> Column:
    """A condition on columns: equality, membership for lists, and ranges for names ending in ``_gte`` or ``_lte``.

    A row whose value is null never passes.
    """
    parts = []
    for k, v in conditions.items():
        if k.endswith("_gte"):
            parts.append(F.col(k[:-4]) >= F.lit(v))
        elif k.endswith("_lte"):
            parts.append(F.col(k[:-4]) <= F.lit(v))
        elif isinstance(v, (list, tuple, set)):
            parts.append(F.col(k).isin(*v))
        else:
            parts.append(F.col(k) == F.lit(v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


_HITS = "query_id bigint, doc_id bigint, score double"


def _best(part: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def flat_search(vectors: DataFrame, queries: DataFrame, k: int = 10, unit: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` largest inner products (``unit``: cosines) per query, exactly.

    ``vectors``: (doc_id bigint, vector); ``queries``: (query_id bigint, vector). Queries are sent to the
    tasks in blocks of a fixed size; each task multiplies its rows with a block and hands on its own
    best ``k``, so the shuffle carries at most k rows per query and task. Scores are rounded to nine
    places before they are ranked; ties go by doc_id. Null vectors and ids are left out.
    """
    v = vectors.where("vector is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "vector")
    q = queries.where("vector is not null and query_id is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    sized = q.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-sized["n"] * (sized["d"] or 0) * 8 // BLOCK_BYTES))
    out = None
    for i in range(blocks):
        mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        part = _search_block(v, [(r["query_id"], list(r["vector"])) for r in mine.collect()], k, unit)
        out = part if out is None else out.unionByName(part)
    return _best(out, k)


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-8)


def _search_block(v: DataFrame, block: list[tuple[int, list[float]]], k: int, unit: bool) -> DataFrame:
    ids = np.array([x[0] for x in block], np.int64)
    mat = np.array([x[1] for x in block], np.float64) if block else np.empty((0, 0))
    shared = v.sparkSession.sparkContext.broadcast((ids, _scaled(mat) if unit and len(block) else mat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qm = shared.value
        if not len(qid):
            return
        best = np.full((len(qid), 0), 0.0)
        who = np.full((len(qid), 0), 0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(1))
            s = np.round(qm @ (_scaled(m) if unit else m).T, 9)
            best = np.concatenate((best, s), 1)
            who = np.concatenate((who, np.broadcast_to(b.column(0).to_numpy(), s.shape)), 1)
            if best.shape[1] > k:
                order = np.lexsort((who, -best), axis=1)[:, :k]
                best, who = np.take_along_axis(best, order, 1), np.take_along_axis(who, order, 1)
        if best.shape[1]:
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(who.ravel()), pa.array(best.ravel())], names=["query_id", "doc_id", "score"])

    return v.mapInArrow(run, _HITS)


def _query_blocks(q: DataFrame, each_bytes: int = 0) -> Iterator[list[tuple[int, list[float]]]]:
    """The queries in blocks of at most ``BLOCK_BYTES``, one after the other on the driver."""
    sized = q.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-sized["n"] * ((sized["d"] or 0) * 8 + each_bytes) // BLOCK_BYTES))
    for i in range(blocks):
        mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        yield [(r["query_id"], list(r["vector"])) for r in mine.collect()]


class _Best:
    """The best ``k`` hits per query so far, from flat arrays of (query number, id, score)."""

    def __init__(self, k: int):
        self.k, self.q, self.d, self.s = k, [], [], []

    def add(self, q: np.ndarray, d: np.ndarray, s: np.ndarray) -> None:
        self.q.append(q)
        self.d.append(d)
        self.s.append(s)
        if sum(map(len, self.q)) > 2_000_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, s = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((self.q, np.int64), (self.d, np.int64), (self.s, np.float64)))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.k
        self.q, self.d, self.s = [q[keep]], [d[keep]], [s[keep]]
        return self.q[0], self.d[0], self.s[0]


@dataclass
class InvertedFile:
    """Cells of vectors: centroids (cells x dim, on the driver, at most ``MOST_CELLS`` rows), rows (doc_id, vector, cell), cells to probe."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int

    def save(self, path: str) -> None:
        """Rows partitioned by cell, so that a probe reads its cells' folders only; centroids as JSON."""
        self.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(json.dumps(self.centroids.tolist()), self.probes)], "centroids string, probes int").coalesce(1).write.mode("overwrite").json(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        c = spark.read.json(f"{path}/centroids").first()
        return InvertedFile(np.array(json.loads(c["centroids"])), spark.read.parquet(f"{path}/rows"), int(c["probes"]))


#: Most cells of an inverted file.
MOST_CELLS = 4096


def _nearest_cells(m: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Per row the ``n`` cells whose centroid has the largest cosine with it, nearest first."""
    return np.argsort(-(_scaled(m) @ centroids.T), axis=1, kind="stable")[:, :n]


def _cell_of(vec: Column, centroids: np.ndarray) -> Column:
    @F.arrow_udf("int")
    def nearest(col: pa.Array) -> pa.Array:
        if not len(col):
            return pa.array([], pa.int32())
        return pa.array((_scaled(_matrix(col)) @ centroids.T).argmax(1).astype(np.int32))

    return nearest(vec)


def build_ivf(vectors: DataFrame, cells: int | None = None, seed: int = 7, rounds: int = 10, aim: float = 0.95, k: int = 10) -> InvertedFile:
    """Fit cells by k-means over directions; every row gets a cell.

    ``cells``: twice the square root of the number of rows by default, so that a cell's rows and the
    centroids grow alike. Centroids, and the number of cells to probe for a share ``aim`` of the ``k``
    nearest rows, are fitted on at most ``FIT_ROWS`` rows, drawn by a hash of their ids; where the data
    does not cluster, that number is large. Null vectors and ids are left out; no rows give no cells.
    """
    v = vectors.where("vector is not null and doc_id is not null").select("doc_id", "vector")
    n = v.count()
    if not n:
        return InvertedFile(np.empty((0, 0)), v.withColumn("cell", F.lit(0)), 0)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT_ROWS / n))
    m = _scaled(np.array(v.where(drawn).limit(FIT_ROWS * 2).select("vector").toPandas()["vector"].tolist(), np.float64))
    rng = np.random.default_rng(seed)
    count = min(cells or int(2 * n**0.5) or 1, MOST_CELLS, len(m))
    c = m[rng.choice(len(m), count, replace=False)].copy()
    for _ in range(rounds):
        near = (m @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, m)
        full = np.bincount(near, minlength=count) > 0
        c[full] = _scaled(total[full])
    asked = m[rng.choice(len(m), min(200, len(m)), replace=False)]
    own = (m @ c.T).argmax(1)
    s = asked @ m.T
    best = np.argpartition(-s, min(k, len(m) - 1), axis=1)[:, :k]
    place = np.empty((len(asked), count), np.int64)
    np.put_along_axis(place, np.argsort(-(asked @ c.T), axis=1, kind="stable"), np.arange(count)[None], 1)
    ranks = np.take_along_axis(place, own[best], 1)  # which probe finds a true neighbour
    return InvertedFile(c, v.withColumn("cell", _cell_of(F.col("vector"), c)), int(np.ceil(np.quantile(ranks, aim))) + 1)


def ivf_search(index: InvertedFile, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): best inner products from the ``nprobe`` nearest cells of each query (default: as fitted).

    Queries travel to the tasks in blocks; a task multiplies the rows of a cell with the queries that
    probe it. Cells that no query probes are not read.
    """
    v = index.rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "vector", "cell")
    q = queries.where("vector is not null and query_id is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    probes = nprobe or index.probes
    out = None
    for block in _query_blocks(q, probes * 8):
        part = _search_cells(v, block, index.centroids, probes, k)
        out = part if out is None else out.unionByName(part)
    return _best(out, k)


def _search_cells(v: DataFrame, block: list[tuple[int, list[float]]], centroids: np.ndarray, probes: int, k: int) -> DataFrame:
    ids, mat = np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], np.float64)
    by_cell: dict[int, np.ndarray] = {}
    if len(block) and len(centroids):
        near = _nearest_cells(mat, centroids, probes)
        by_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    shared = v.sparkSession.sparkContext.broadcast((ids, mat, by_cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qm, who = shared.value
        best = _Best(k)
        for b in batches:
            if not b.num_rows:
                continue
            doc, m, cell = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            for c in np.unique(cell):
                if c not in who:
                    continue
                at = np.flatnonzero(cell == c)
                s = np.round(qm[who[c]] @ m[at].T, 9)
                best.add(np.repeat(who[c], len(at)), np.tile(doc[at], len(who[c])), s.ravel())
        q, d, s = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "score"])

    return v.where(F.col("cell").isin(list(by_cell))).mapInArrow(run, _HITS)


@dataclass(frozen=True)
class Hyperplanes:
    """``tables`` sets of ``bits`` random hyperplanes; a vector's code in a table is the sides on which it lies."""

    dim: int
    tables: int = 8
    bits: int = 6
    seed: int = 11

    def codes(self, m: np.ndarray, probe: bool = False) -> np.ndarray:
        """rows x tables codes; with ``probe`` rows x tables x (bits + 1): the code and those one side away."""
        planes = np.random.default_rng(self.seed).normal(size=(self.tables, self.bits, self.dim))
        side = np.einsum("nd,tbd->ntb", m, planes) > 0
        code = (side * (1 << np.arange(self.bits))).sum(2)
        return np.concatenate((code[..., None], code[..., None] ^ (1 << np.arange(self.bits))), 2) if probe else code


def bits_for(rows: int) -> int:
    """Hyperplanes per table so that the cells of a table grow with the square root of the rows, at least 4."""
    return max(4, min(30, round(np.log2(max(rows, 1)) / 2)))


def lsh_search(vectors: DataFrame, queries: DataFrame, planes: Hyperplanes, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): best cosines among the rows that share a table's code with a query, or miss it by one side.

    Takes the place of a graph index: approximate search without a fit. Each task hashes its rows and
    scores them against the queries (in blocks) that probe their codes; only its best ``k`` per query leave it.
    """
    v = vectors.where("vector is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "vector")
    q = queries.where("vector is not null and query_id is not null").select(F.col("query_id").cast("bigint").alias("query_id"), "vector")
    out = None
    for block in _query_blocks(q, planes.tables * (planes.bits + 1) * 8):
        ids, mat = np.array([x[0] for x in block], np.int64), _scaled(np.array([x[1] for x in block], np.float64).reshape(len(block), planes.dim))
        probed = planes.codes(mat, True) if len(block) else np.empty((0, planes.tables, 1), np.int64)
        shared = v.sparkSession.sparkContext.broadcast((ids, mat, probed))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qm, probed = shared.value
            best = _Best(k)
            for b in batches:
                if not b.num_rows or not len(qid):
                    continue
                doc, m = b.column(0).to_numpy(), _scaled(_matrix(b.column(1)))
                code = planes.codes(m)
                met = np.zeros((len(qid), len(doc)), bool)
                for t in range(planes.tables):
                    for c in np.unique(code[:, t]):
                        asked = np.flatnonzero((probed[:, t] == c).any(1))
                        if len(asked):
                            met[np.ix_(asked, np.flatnonzero(code[:, t] == c))] = True
                a, i = np.nonzero(met)
                best.add(a, doc[i], np.round(np.einsum("nd,nd->n", qm[a], m[i]), 9))
            a, d, s = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "score"])

        part = v.mapInArrow(run, _HITS)
        out = part if out is None else out.unionByName(part)
    return _best(out, k)


def choose_index(n_rows: int, at: int = 50_000) -> str:
    """``flat`` up to ``at`` rows, ``ivf`` beyond; a default that :func:`corpuslane.plans.pipeline.build_index` lets the caller override."""
    return "ivf" if n_rows > at else "flat"


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact hits (query_id, doc_id) that the approximate search found."""
    hit = exact.select("query_id", "doc_id").join(approximate.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("hits"))
