import random

import numpy as np

from corpuslane.llm import leakage
from corpuslane.llm.leakage import FMIndex, Phrases, find_leaks, suffix_array, word_spans, words


def random_text(rng, n, sigma):
    t = rng.integers(0, sigma, n)
    t[0] = 0
    return t


def test_suffix_array_and_search_equal_brute_force():
    rng = np.random.default_rng(3)
    for n, sigma in ((40, 3), (300, 4), (500, 9), (200, 2)):
        t = random_text(rng, n, sigma)
        seps = int((t == 0).sum())
        order = {}
        seen = 0
        for i, c in enumerate(t.tolist()):
            order[i] = seen if c == 0 else seps + c
            seen += c == 0
        full = [tuple(order[j] for j in range(i, n)) for i in range(n)]
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: full[i])
        ix = FMIndex(t, sigma)
        for m in (1, 2, 5):
            pats = rng.integers(1, sigma, (30, m)) if sigma > 1 else np.ones((1, m), np.int64)
            lo, hi = ix.search(pats)
            for p, a, b in zip(pats, lo, hi):
                at = sorted(ix.locate(np.arange(a, b)).tolist())
                assert at == [i for i in range(n - m + 1) if (t[i : i + m] == p).all()]


def brute(docs, items, size):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i, p in items:
            v = words(p or "")
            if any(tuple(v[k : k + size]) in grams for k in range(len(v) - size + 1)):
                out.add((d, i))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["École", "straße", "naïve", "x_y", "µg"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 40)))) for k in range(40)]
    items += [(100, None), (101, ""), (102, items[0][1]), (103, items[1][1].upper())]
    docs = []
    for d in range(150):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            p = words(rng.choice(items[:40])[1])
            a = rng.randrange(len(p))
            parts.append("  ,;\n".join(p[a : a + rng.randrange(5, 30)]))
            parts.append(" ".join(rng.choice(vocabulary + ["other"]) for _ in range(rng.randrange(0, 12))))
        docs.append((d, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "___"), (0, docs[0][1])], items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    want = brute(docs, items, 12)
    out = find_leaks(d, i).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want and len(want) > 20
    text = dict(docs)
    for r in out:
        for s in r["spans"]:
            assert len(words(text[r["doc_id"]][s["start"] : s["end"]])) >= 12
        assert r["words"] == sum(len(words(text[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"])
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 600)  # test items in blocks
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(d, i).collect()} == want


def test_many_shards_give_the_same():
    docs, items = cases()
    p = Phrases([(i, t) for i, t in items if t], 12)
    whole = sorted((n, i, tuple(s)) for n, i, s in p.leaks([t for _, t in docs]))
    parts = []
    for k in range(0, len(docs), 7):
        parts += [(n + k, i, tuple(s)) for n, i, s in p.leaks([t for _, t in docs[k : k + 7]])]
    assert sorted(parts) == whole


def test_offsets_with_accents():
    t = "Ünï — café ﬁn, x2"  # composed, decomposed, a ligature
    assert [t[a:b] for a, b in word_spans(t)] == ["Ünï", "café", "ﬁn", "x2"]
    assert words(t) == ["uni", "cafe", "fin", "x2"]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, passage string")
    assert find_leaks(d, i).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a " * 50)], "doc_id bigint, text string"), i).count() == 0
