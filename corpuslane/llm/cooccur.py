"""Problem 2: items that appear together, with lift and log-likelihood ratio.

Method: stripes. Each task builds, per item, an associative array of the neighbours it occurs with
and their counts. The arrays are shuffled as they are and merged by item, and only the merged ones are
exploded to pairs; significance comes from the merged counts. The diagonal of a stripe holds the
item's own count, so one pass gives pairs and margins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.session import materialize

#: Cells of stripes that a task holds before it sends them on; bounds its memory.
FLUSH_CELLS = 2_000_000
#: A stripe is spread over so many keys by its neighbours, so that a hot item's stripe is no single row.
STRIPE_BUCKETS = 16
#: Items that hold more than 1/HOT of all records' items, of which there are fewer than HOT, meet their margins by broadcast.
HOT = 2000

_STRIPE = "item string, bucket int, neighbours array<string>, counts array<bigint>"


def mesh_item(c):
    """The descriptor of a MeSH entry: before ``/``, without ``*``, lower-cased, trimmed, inner spaces made single."""
    return F.trim(F.regexp_replace(F.lower(F.replace(F.split_part(c, F.lit("/"), F.lit(1)), F.lit("*"), F.lit(""))), r"\s+", " "))


def keyword_item(c):
    """A keyword, lower-cased, trimmed, inner spaces made single."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def record_items(df: DataFrame, record: str, field: str) -> DataFrame:
    """(record, item) of ``field`` (``mesh_terms`` or ``keywords``) in every row, with repeats.

    Null records, null arrays, null and empty items give no row.
    """
    e = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.explode(field).alias("x"))
    if field == "keywords":
        e = e.select("record", F.explode(F.split("x", ";")).alias("x")).select("record", keyword_item(F.col("x")).alias("item"))
    else:
        e = e.select("record", mesh_item(F.col("x")).alias("item"))
    return e.where(F.col("item") != "")


def _stripe_rows(names: pa.Array, item: np.ndarray, bucket: np.ndarray, near: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``_STRIPE`` from cells sorted by item and bucket; items and neighbours are places in ``names``."""
    change = (np.diff(item) != 0) | (np.diff(bucket) != 0)
    cut = np.concatenate(([0], np.flatnonzero(change) + 1, [len(item)])).astype(np.int32)
    for lo in range(0, len(cut) - 1, 20_000):
        at = cut[lo : lo + 20_001]
        s = slice(at[0], at[-1])
        off = pa.array(at - at[0])
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(item[at[:-1]])),
                pa.array(bucket[at[:-1]]),
                pa.ListArray.from_arrays(off, names.take(pa.array(near[s]))),
                pa.ListArray.from_arrays(off, pa.array(n[s])),
            ],
            names=["item", "bucket", "neighbours", "counts"],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One stripe per item and bucket from stripes sorted by both; a stripe in the making holds each neighbour once."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if kept is None else [kept, batch.cast(kept.schema)]).combine_chunks()
        item, bucket = table.column(0).combine_chunks().dictionary_encode(), table.column(1).to_numpy()
        lists, counts = table.column(2).combine_chunks(), table.column(3).combine_chunks()
        if isinstance(item, pa.ChunkedArray):
            item = item.chunk(0)
        row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
        near = lists.flatten().dictionary_encode()
        code, n = near.indices.to_numpy().astype(np.int64), counts.flatten().to_numpy()
        place = item.indices.to_numpy()
        run = np.concatenate(([0], np.cumsum((np.diff(place) != 0) | (np.diff(bucket) != 0))))
        key = run[row] * len(near.dictionary) + code
        u, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        first = np.searchsorted(run, u // len(near.dictionary))
        names = pa.concat_arrays([item.dictionary, near.dictionary])
        rows = list(_stripe_rows(names, place[first].astype(np.int64), bucket[first], u % len(near.dictionary) + len(item.dictionary), total))
        # the last stripe may go on in the next batch
        last = rows.pop()
        kept = last.slice(last.num_rows - 1)
        yield from rows
        if last.num_rows > 1:
            yield last.slice(0, last.num_rows - 1)
    if kept is not None:
        yield kept


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the record arrays in a task: one row per item and bucket of neighbours, with neighbours and counts."""
    words: dict[str, int] = {}
    bucket_of: list[int] = []
    held: dict[str, list] = {"k": [], "n": []}
    cells = 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        k, n = np.concatenate(held["k"]), np.concatenate(held["n"])
        u, at = np.unique(k, return_inverse=True)
        return u, np.bincount(at, weights=n).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        if not held["k"]:
            return
        u, n = merge()
        a, b = (u >> 32).astype(np.int64), (u & 0xFFFFFFFF).astype(np.int64)
        bucket_of.extend(xxhash.xxh3_64_intdigest(w) % STRIPE_BUCKETS for w in list(words)[len(bucket_of) :])
        bucket = np.array(bucket_of, np.int32)[b]
        order = np.lexsort((b, bucket, a))
        yield from _stripe_rows(pa.array(list(words), pa.string()), a[order], bucket[order], b[order], n[order])

    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().dictionary_encode()
        local = np.array([words.setdefault(w, len(words)) for w in flat.dictionary.to_pylist()], dtype=np.int64)
        codes = local[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        for size in np.unique(sizes):
            if size == 0:
                continue
            rows = first[sizes == size]
            # a record's items are sorted by name, so the left one of a pair is the smaller
            i, j = np.triu_indices(size)
            step = max(1, FLUSH_CELLS // len(i))
            for lo in range(0, len(rows), step):
                m = codes[rows[lo : lo + step, None] + np.arange(size)]
                k, n = np.unique((m[:, i] << 32 | m[:, j]).ravel(), return_counts=True)
                held["k"].append(k)
                held["n"].append(n)
                cells += len(k)
                if cells > FLUSH_CELLS:
                    u, n = merge()
                    held["k"], held["n"], cells = [u], [n], len(u)
                    if cells > FLUSH_CELLS // 2:
                        yield from flush()
                        held["k"], held["n"], cells = [], [], 0
        if len(words) > FLUSH_CELLS:
            yield from flush()
            held["k"], held["n"], cells, words, bucket_of = [], [], 0, {}, []
    yield from flush()


def cooccurrence(items: DataFrame, min_together: int = 1) -> DataFrame:
    """Pairs of items on the same record, from (record, item) rows; a record has the union of its rows' items.

    Result: item_a < item_b, n_ab, n_a, n_b, n (records with an item), lift (n_ab over the number
    expected by chance) and llr (log-likelihood ratio G2, negative when rarer than chance).
    ``min_together`` leaves out pairs on fewer records, as the feature of a report; 1 keeps all.
    Null items or records are ignored; repeated rows count once; no rows give no pairs. A record's
    own items must fit a task, since each pair of them is a result; a hot item does not gather:
    its counts are summed within tasks first and its stripe is spread over buckets.
    """
    clean = items.select("record", "item").where(F.col("record").isNotNull() & F.col("item").isNotNull())
    records = clean.groupBy("record").agg(F.array_sort(F.collect_set("item")).alias("items")).select("items")
    stripes = records.mapInArrow(_stripes, _STRIPE).repartition("item", "bucket").sortWithinPartitions("item", "bucket")
    merged = materialize(stripes.mapInArrow(_merged, _STRIPE).drop("bucket"), "stripes")
    cells = merged.select(F.col("item").alias("item_a"), F.explode(F.arrays_zip("neighbours", "counts")).alias("c")).select(
        "item_a", F.col("c.neighbours").alias("item_b"), F.col("c.counts").alias("n_ab")
    )
    margin = materialize(cells.where(F.col("item_a") == F.col("item_b")).select(F.col("item_a").alias("item"), F.col("n_ab").alias("m")), "margins")
    held = margin.agg(F.sum("m")).first()[0] or 0
    hot, rest = margin.where(F.col("m") * HOT > held), margin.where(F.col("m") * HOT <= held)

    def with_margin(df: DataFrame, item: str, out: str) -> DataFrame:
        first = df.join(F.broadcast(hot.withColumnsRenamed({"item": item, "m": out})), item, "left")
        return first.where(F.col(out).isNotNull()).unionByName(first.where(F.col(out).isNull()).drop(out).join(rest.withColumnsRenamed({"item": item, "m": out}), item))

    total = clean.agg(F.countDistinct("record").alias("n"))
    pairs = cells.where((F.col("item_a") < F.col("item_b")) & (F.col("n_ab") >= min_together))
    j = with_margin(with_margin(pairs, "item_a", "n_a"), "item_b", "n_b").crossJoin(F.broadcast(total))  # one row
    return j.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift().alias("lift"), llr().alias("llr"))


def lift():
    """n_ab over n_a n_b / n."""
    return F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))


def llr():
    """Signed log-likelihood ratio of the 2 x 2 table of a pair."""
    nab, na, nb, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))

    def part(k, row, col):
        return F.when(k > 0, k * F.ln(k * n / (row * col))).otherwise(0.0)

    g = 2 * (
        part(nab, na, nb) + part(na - nab, na, n - nb) + part(nb - nab, n - na, nb) + part(n - na - nb + nab, n - na, n - nb)
    )
    return F.when(nab * n < na * nb, -g).otherwise(g)
