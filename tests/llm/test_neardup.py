import itertools
import random

import numpy as np

from corpuslane.llm import neardup
from corpuslane.llm.neardup import NearDupParams, Signer, all_pairs, groups, jaccard, near_duplicates

P = NearDupParams(shingle=3, threshold=0.5, bands=48, rows=3)


def corpus(seed=1, base=12, each=6):
    rng = random.Random(seed)
    out = []
    for _ in range(base):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(45, 120))]
        for _ in range(each):
            w = list(words)
            for _ in range(rng.randrange(0, 14)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(4000)}"
            out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    texts = corpus()
    texts += [texts[0], texts[0].upper() + " !", texts[5]]
    df = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)] + [(9001, texts[0]), (9002, None), (9004, ""), (9006, "few words")], "node bigint, text string")
    r = near_duplicates(df, P)
    got = {(x["a"], x["b"]) for x in all_pairs(r).collect()}
    want = {(2 * i, 2 * j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j], 3) >= 0.5}
    assert got == want and len(want) > 50
    g = {x["node"]: x for x in groups(r).collect()}
    assert set(g) == {2 * i for i in range(len(texts))} | {9001}  # another table's copy stays alone
    for a, b in want:
        assert g[a]["class_id"] == g[b]["class_id"]
    assert g[9001]["class_id"] == 9001 and g[2 * 72]["rep"] == 0


def test_hot_copies_give_no_candidates(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(2 * i, text) for i in range(300)], "node bigint, text string")
    r = near_duplicates(df, P)
    assert r.copies.count() == 299 and r.links.count() == 0


def test_signatures_estimate_similarity():
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" if i % 10 else f"y{i}" for i in range(200))
    p = NearDupParams(shingle=3, threshold=0.5, bands=100, rows=3)
    which, content, sig = Signer(p).sign([a, b, "short", a])
    assert which.tolist() == [0, 1, 3] and content[0] == content[2] != content[1]
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - jaccard(a, b, 3)) < 0.12
    assert np.array_equal(Signer(p).sign([b])[2][0], sig[1])  # the same alone and in a batch


def test_empty_table(spark):
    r = near_duplicates(spark.createDataFrame([], "node bigint, text string"), P)
    assert all_pairs(r).count() == 0 and groups(r).count() == 0


def family(seed=5, size=300):
    """Texts edited so much that about half of all pairs reach the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(size):
        w = list(words)
        at = rng.randrange(len(w))
        for k in range(rng.randrange(20, 60)):  # a stretch of its own
            w[(at + k) % len(w)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_family(spark, monkeypatch):
    texts = family()
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in map(neardup.words, texts)]
    want = {(2 * i, 2 * j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    df = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "node bigint, text string")
    for block in (neardup.BLOCK, 50):  # buckets whole, and cut into blocks
        monkeypatch.setattr(neardup, "BLOCK", block)
        sigs = neardup._sign_all(df, P)
        by_bands = {(x["a"], x["b"]) for x in neardup._candidates(sigs, P).collect()}
        assert len(want & by_bands) >= 0.99 * len(want)
        got = {(x["a"], x["b"]) for x in all_pairs(near_duplicates(df, P)).collect()}
        assert got <= want and len(got) >= 0.998 * len(want)


def test_tight_family_has_few_candidates(spark, monkeypatch):
    """Of 400 texts that differ by a word or two all pairs are found, through candidates that grow with the texts only."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(400):
        w = list(words)
        w[rng.randrange(200)] = f"x{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "node bigint, text string")
    n = len(texts)
    for block in (neardup.BLOCK, 60):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert n - 1 <= neardup._candidates(neardup._sign_all(df, P), P).count() <= 60 * n
        r = near_duplicates(df, P, closed=False)
        assert {x["class_id"] for x in groups(r).collect()} == {0} and r.links.count() <= 60 * n
        assert near_duplicates(df, P).links.count() == n * (n - 1) // 2


def test_stars_cover_a_block():
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 256, (60, 96)).astype(np.uint8)
    sig[20:40] = sig[0]
    sig[30:40, :40] = rng.integers(0, 256, (10, 40))
    pairs, centres = neardup.stars(np.arange(60), sig, 40, 80)
    equal = (sig[:, None] == sig[None]).sum(2)
    for c in centres:
        assert {int(y) for x, y in pairs if x == c} == {j for j in range(60) if j != c and equal[c, j] >= 40}
    for j in range(60):
        assert j in centres or (equal[j, centres] >= 80).any()


def test_repeated_keys_across_batches():
    import pyarrow as pa

    key = [1, 2, 2, 2, 3, 4, 4, 5, 5, 5, 5, 6]
    for cut in range(1, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + cut]), pa.array(range(i, min(i + cut, 12)))], names=["key", "node"]) for i in range(0, 12, cut)]
        got = [(k, n) for b in neardup._repeated(iter(batches)) for k, n in zip(*(c.to_pylist() for c in b.columns))]
        assert got == [(k, n) for n, k in enumerate(key) if key.count(k) > 1]
