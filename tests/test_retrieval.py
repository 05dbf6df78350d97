import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslane.operators import dense, embedding, metrics, retrieval, sparse


def hits(spark, rows):
    return spark.createDataFrame([(1, d, r) for r, d in enumerate(rows, 1)], "query_id bigint, doc_id string, rank int")


def test_fusion_golden(spark):
    out = retrieval.fuse(hits(spark, ["A", "B"]), hits(spark, ["B", "C"])).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in out] == [("B", 0.016208), ("A", 0.011475), ("C", 0.004839)]
    assert retrieval.fuse(hits(spark, []), hits(spark, ["B"])).count() == 1


def test_metrics_golden(spark):
    truth = spark.createDataFrame([(1, d) for d in ("d2", "d5", "d9")], "query_id bigint, doc_id string")
    m = {r["k"]: r for r in metrics.retrieval_metrics(hits(spark, ["d1", "d2", "d3", "d4", "d5"]), truth, (1, 5)).collect()}
    assert m[1]["precision"] == 0 and m[5]["precision"] == 0.4 and round(m[5]["recall"], 6) == 0.666667 and round(m[5]["ndcg"], 6) == 0.477624 and m[5]["mrr"] == 0.5
    none = metrics.retrieval_metrics(hits(spark, ["d1"]), truth.limit(0), (1,)).first()
    assert (none["precision"], none["recall"], none["ndcg"], none["mrr"], none["n_queries"]) == (0, 0, 0, 0, 1)


def test_bm25_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    words = ["heart", "renal", "pain", "dose", "mri", "x9", "stroke"]
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for i in range(60)}
    df = spark.createDataFrame([*docs.items(), (99, None)], "doc_id bigint, text string")
    q = {1: "heart heart pain", 2: "stroke of mri", 3: "nothing", 4: ""}
    qd = spark.createDataFrame([*q.items(), (5, None)], "query_id bigint, text string")
    n, avg = len(docs), sum(len(t.split()) for t in docs.values()) / len(docs)
    freq = Counter(w for t in docs.values() for w in set(t.split()))
    want = {}
    for k, t in q.items():
        for d, x in docs.items():
            tf, s = Counter(x.split()), 0.0
            for w in t.split():
                if tf[w]:
                    s += math.log((n - freq[w] + 0.5) / (freq[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x.split()) / avg))
            if s > 0:
                want[k, d] = s
    ix = sparse.build(df)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in sparse.search(ix, qd, 1000).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())
    top = sparse.search(ix, qd, 3).where("query_id = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in top] == sorted((d for k, d in want if k == 1), key=lambda d: (-round(want[1, d], 9), d))[:3]
    ix.save(str(tmp_path / "ix"), 4)
    again = sparse.search(sparse.SparseIndex.load(spark, str(tmp_path / "ix")), qd, 1000)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in again.collect()} == pytest.approx(got)
    split = sparse.build(df.where("doc_id < 30")).add(df.where("doc_id >= 30"))
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in sparse.search(split, qd, 1000).collect()} == pytest.approx(got)
    kept = sparse.search(ix, qd, 1000, df.where("doc_id < 10").select("doc_id")).collect()
    assert {r["doc_id"] for r in kept} <= set(range(10))


def test_dense_equals_numpy_in_blocks(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 4) for i in range(200)] + [(900, None, 1)], "doc_id bigint, vector array<float>, label int")
    q = df.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    want = {}
    for i in range(0, 200, 20):
        s = np.round(v[i].astype(float) @ v.astype(float).T, 9)
        for rank, j in enumerate(sorted(range(200), key=lambda j: (-s[j], j))[:7], 1):
            want[i, j] = rank
    got = {(r["query_id"], r["doc_id"]): r["rank"] for r in dense.flat_search(df, q, 7).where("query_id < 900").collect()}
    assert got == want
    monkeypatch.setattr(dense, "BLOCK_BYTES", 100)
    assert {(r["query_id"], r["doc_id"]): r["rank"] for r in dense.flat_search(df, q, 7).where("query_id < 900").collect()} == want
    ix = dense.build_ivf(df, 8)
    assert ix.rows.count() == 200
    assert {(r["query_id"], r["doc_id"]): r["rank"] for r in dense.ivf_search(ix, q, 7, 8).collect()} == want  # all cells: exact
    ix.save(str(tmp_path / "ivf"))
    assert dense.ivf_search(dense.InvertedFile.load(spark, str(tmp_path / "ivf")), q, 7, 8).count() == len(want)
    assert dense.flat_search(df.limit(0), q, 3).count() == 0 and dense.flat_search(df, q.limit(0), 3).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 2000), (2, "b", None), (3, None, 2010)], "i int, k string, year int")

    def ids(c):
        return [r["i"] for r in df.where(dense.metadata_filter(c)).orderBy("i").collect()]

    assert ids({}) == [1, 2, 3] and ids({"k": ["a", "b"]}) == [1, 2] and ids({"year_gte": 2005}) == [3] and ids({"year_lte": 2005, "k": "a"}) == [1]
    assert dense.choose_index(10) == "flat" and dense.choose_index(60_000) == "ivf"


def test_expansion_and_rerank(spark):
    df = spark.createDataFrame([("stroke care",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(retrieval.expand(F.col("t"))).collect()] == ["stroke care cerebrovascular accident CVA cerebral infarction brain attack", "plain", None]
    q = spark.createDataFrame([(1, "red green")], "query_id bigint, text string")
    d = spark.createDataFrame([("A", "blue"), ("B", "Green red"), ("C", "red"), ("D", None)], "doc_id string, text string")
    out = retrieval.rerank(hits(spark, ["A", "D", "C", "B"]), q, d, 3).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["rerank_score"], 3)) for r in out] == [("B", 1.0), ("C", 0.667), ("A", 0.0)]


def test_embedding_and_cache(spark):
    m = embedding.HashingProvider()
    t = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "a b a")], "i int, text string")
    v = {r["i"]: r["v"] for r in t.select("i", embedding.embed(F.col("text"), m).alias("v")).collect()}
    assert v[2] is None and v[1] == v[4] and abs(sum(x * x for x in v[1]) - 1) < 1e-6 and sum(v[3]) == 0
    cache = spark.createDataFrame([], "model string, key string, vector array<float>")
    new = embedding.fill_cache(t, cache, m)
    assert new.count() == 2
    hit, miss = embedding.cache_split(t, new, m.name)
    assert hit.count() == 3 and miss.count() == 0 and embedding.provider("hashing-64").dim == 64
    c = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(embedding.l2_normalise(F.col("a")), embedding.cosine(F.col("a"), F.col("b"))).first()
    assert c[0] == [0.6, 0.8] and c[1] == 0
