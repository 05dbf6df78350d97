import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpuslane.functions.text import sentences_biomedical
from corpuslane.operators import chunking, embedding


def tokens(t):
    return math.floor(len(t.split()) * 1.3)


def brute(sents, size, lap, least):
    out, cur, n = [], [], 0
    for s in sents:
        t = tokens(s)
        if cur and n + t > size:
            out.append(" ".join(cur))
            keep, k = [], 0
            for p in reversed(cur):
                if k + tokens(p) > lap:
                    break
                keep.insert(0, p)
                k += tokens(p)
            cur, n = keep, k
        cur.append(s)
        n += t
    if cur and tokens(" ".join(cur)) >= least:
        out.append(" ".join(cur))
    return out


def documents(spark, n=40):
    rng = random.Random(0)
    rows = [(i, " ".join(f"Sentence {j} " + "word " * rng.randrange(0, 30) + "end." for j in range(rng.randrange(0, 25)))) for i in range(n)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "short.")], "doc_id bigint, text string")


def test_sentence_chunks_equal_brute_force(spark):
    d = documents(spark)
    sents = {r["doc_id"]: (r["s"], r["text"]) for r in d.select("doc_id", "text", sentences_biomedical(F.col("text")).alias("s")).collect()}
    got = {}
    for r in chunking.sentence_chunks(d, 60, 20, 10).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, (s, text) in sents.items():
        want = brute(s or [], 60, 20, 10)
        assert [r["text"] for r in got.get(k, [])] == want
        for r in got.get(k, []):
            assert r["chunk_id"] == f"{k}_chunk_{r['chunk_index']}" and r["token_count"] == tokens(r["text"]) and r["char_end"] == r["char_start"] + len(r["text"])
            assert text[r["char_start"] :].startswith(r["text"].split(". ")[0])
    assert chunking.chunk(d.limit(0)).count() == 0


def test_breakpoints_equal_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(i // 10, i, [float(x) for x in v[i]]) for i in range(30)], "k int, pos int, v array<double>")
    rows = chunking.breakpoints(df, "k", "pos", "v").orderBy("pos").collect()
    for g in range(3):
        w = v[g * 10 : g * 10 + 10]
        u = w / np.linalg.norm(w, axis=1, keepdims=True)
        sim = (u[:-1] * u[1:]).sum(1)
        cut = np.percentile(sim, 15)
        mine = rows[g * 10 : g * 10 + 10]
        assert np.allclose([r["sim"] for r in mine[:-1]], sim) and [r["is_break"] for r in mine] == [*(sim < cut), False]


def test_semantic_chunks_equal_brute_force(spark):
    d = documents(spark)
    m = embedding.HashingProvider(8, False, "hashing-8")
    sents = {r["doc_id"]: (r["s"] or []) for r in d.select("doc_id", sentences_biomedical(F.col("text")).alias("s")).collect()}
    want = {}
    for k, s in sents.items():
        if len(s) < 3:
            want[k] = brute(s, 60, 20, 10)
            continue
        v = m.encode(s).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
        sim = (v[:-1] * v[1:]).sum(1)
        cut = np.percentile(sim, 15)
        groups = [[s[0]]]
        for i, x in enumerate(s[1:]):
            if sim[i] < cut:
                groups.append([])
            groups[-1].append(x)
        want[k] = []
        for g in groups:
            n = tokens(" ".join(g))
            want[k] += [] if n < 10 else [" ".join(g)] if n <= 60 else brute(g, 60, 20, 10)
    got = {}
    for r in chunking.semantic_chunks(d, m, 85.0, 60, 10, 20).orderBy("doc_id", "chunk_index").collect():
        assert r["chunk_index"] == len(got.setdefault(r["doc_id"], [])) and r["token_count"] == tokens(r["text"])
        got[r["doc_id"]].append(r["text"])
    assert got == {k: v for k, v in want.items() if v}


def test_section_chunks(spark):
    s = spark.createDataFrame([(1, 0, "plan", "One two three. " * 20), (1, 1, "plan", "Four five six. " * 20), (2, 0, None, "x")], "doc_id int, ord int, section_name string, text string")
    out = chunking.section_chunks(s, 30, 6, 5).orderBy("doc_id", "chunk_index").collect()
    assert [r["chunk_index"] for r in out] == list(range(len(out))) and {r["ord"] for r in out} == {0, 1}
