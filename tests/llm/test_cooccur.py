import itertools
import math
from collections import Counter, defaultdict

import numpy as np

from corpuslane.llm import cooccur


def brute(rows):
    by = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            by[r].add(i)
    one = Counter(i for s in by.values() for i in s)
    two = Counter(p for s in by.values() for p in itertools.combinations(sorted(s), 2))
    return {(a, b): (n, one[a], one[b], len(by)) for (a, b), n in two.items()}


def test_equals_brute_force_with_a_hot_item(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{k}", "hot") for k in range(200)] + [(f"r{int(a)}", f"i{int(b)}") for a, b in zip(rng.integers(0, 200, 900), rng.integers(0, 30, 900))]
    rows += [(None, "x"), ("r1", None), ("r1", "hot"), ("lone", "solo")]
    out = cooccur.cooccurrence(spark.createDataFrame(rows, "record string, item string")).collect()
    want = brute(rows)
    assert {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in out} == want
    for r in out:
        nab, na, nb, n = want[r["item_a"], r["item_b"]]
        assert math.isclose(r["lift"], nab * n / (na * nb))
        cells = [(nab, na, nb), (na - nab, na, n - nb), (nb - nab, n - na, nb), (n - na - nb + nab, n - na, n - nb)]
        g = 2 * sum(k * math.log(k * n / (x * y)) for k, x, y in cells if k)
        assert math.isclose(abs(r["llr"]), abs(g), abs_tol=1e-9) and (r["llr"] >= 0) == (nab * n >= na * nb or abs(g) < 1e-12)


def test_stripes_flush_and_merge(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cooccur, "FLUSH_CELLS", 10)
    lists = [sorted({f"w{(i * j) % 17}" for j in range(6)}) for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 8], pa.list_(pa.string()))], names=["items"]) for i in range(0, 40, 8)]
    got = Counter()
    for b in cooccur._stripes(iter(batches)):
        for item, _, near, n in zip(*(c.to_pylist() for c in b.columns)):
            for x, k in zip(near, n):
                got[item, x] += k
    want = Counter((a, b) for s in lists for i, a in enumerate(s) for b in s[i:])
    assert got == want


def test_arrays_merge_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = sorted((f"i{rng.integers(0, 4)}", int(rng.integers(0, 3)), sorted({f"n{x}" for x in rng.integers(0, 9, 4)})) for _ in range(40))
    want = Counter((i, b, x) for i, b, near in rows for x in near)
    for size in (1, 3, 40):
        got = Counter()
        kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))
        cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [[1] * len(r[2]) for r in rows]]
        t = pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item", "bucket", "neighbours", "counts"])
        seen = []
        for b in cooccur._merged(iter(t.to_batches(max_chunksize=size))):
            for item, bucket, near, n in zip(*(c.to_pylist() for c in b.columns)):
                seen.append((item, bucket))
                for x, k in zip(near, n):
                    got[item, bucket, x] += k
        assert got == want and len(seen) == len(set(seen))


def test_items_and_empty_tables(spark):
    df = spark.createDataFrame(
        [("1", ["*Heart  Attack/therapy", " heart attack ", None, "/x"], ["a ; B", "b"]), ("2", None, None), (None, ["q"], ["q"])],
        "pmid string, mesh_terms array<string>, keywords array<string>",
    )
    assert {tuple(r) for r in cooccur.record_items(df, "pmid", "mesh_terms").collect()} == {("1", "heart attack")}
    assert {tuple(r) for r in cooccur.record_items(df, "pmid", "keywords").collect()} == {("1", "a"), ("1", "b")}
    assert cooccur.cooccurrence(spark.createDataFrame([], "record string, item string")).count() == 0
