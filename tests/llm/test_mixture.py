import math

import numpy as np
import pytest

from corpuslane.llm.mixture import Tokenizer, fit_rate, mixture, mixture_shares, poisson_thresholds, token_count


def test_thresholds_are_poisson():
    t = poisson_thresholds(2.0, 5)
    assert math.isclose(t[0], math.exp(-2)) and math.isclose(t[1], 3 * math.exp(-2)) and t == sorted(t)
    assert poisson_thresholds(math.inf, 3) == [-1.0] * 3 and poisson_thresholds(0, 2) == [2.0, 2.0]


@pytest.mark.parametrize(("cap", "goal"), [(1, 0.3), (3, 1.7), (6, 5.5), (4, 4.0), (2, 0.0)])
def test_fitted_rate_reaches_the_goal(cap, goal):
    rng = np.random.default_rng(0)
    u, w = rng.random(20_000), rng.integers(50, 500, 20_000).astype(float)
    rate = fit_rate(u, w, cap, goal * w.sum())
    reached = sum(w[u > t].sum() for t in poisson_thresholds(rate, cap))
    assert abs(reached / w.sum() - goal) < 0.01


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"word{i} of some text number {i} " * (1 + i % 7), s, "old") for s, n in (("big", 3000), ("mid", 600), ("small", 120)) for i in range(n)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    rows += [(90_001, None, "mid", "x"), (90_002, "", "mid", "x"), (90_003, "text", None, "x"), (90_004, "text", "untargeted", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    goal = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.2, 2), ("small", 0.2, 4), ("absent", 0.1, 3), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    return docs, goal


def test_shares_caps_and_report(spark, tables):
    docs, goal = tables
    r = {x["source"]: x for x in mixture_shares(docs, goal).collect()}
    assert set(r) == {"big", "mid", "small", "absent"} and r["absent"]["reached_tokens"] == 0 and r["absent"]["share_with_text"] == 0
    for k, caps in (("big", 1), ("mid", 2), ("small", 4)):
        assert abs(r[k]["reached_share"] - r[k]["share_with_text"]) < 0.01 and r[k]["most_copies"] <= caps
    m = mixture(docs, goal).toPandas()
    assert m.groupby("source").n_tokens.sum().to_dict() == {k: r[k]["reached_tokens"] for k in ("big", "mid", "small")}
    copies = m.groupby(["source", "doc_id"]).size()
    assert copies["small"].max() == 4 and copies["big"].max() == 1
    assert not m.duplicated(["doc_id", "copy"]).any() and not m.doc_id.isin([90_001, 90_002, 90_003, 90_004]).any()
    again = mixture(docs.repartition(7), goal).toPandas()
    key = ["doc_id", "copy", "shuffle_key"]
    assert sorted(map(tuple, m[key].values)) == sorted(map(tuple, again[key].values))
    runs = np.diff(np.flatnonzero(np.diff(m.source.astype("category").cat.codes.to_numpy()))).max()
    assert runs < 60  # sources are shuffled among each other


def test_more_than_the_caps_allow(tables):
    docs, goal = tables
    r = {x["source"]: x for x in mixture_shares(docs, goal, total_tokens=1e9).collect()}
    assert all(r[k]["most_copies"] == c and r[k]["rows_out"] == n * c for k, c, n in (("big", 1, 3000), ("mid", 2, 600), ("small", 4, 120)))


def test_empty_tables(spark, tables):
    docs, goal = tables
    assert mixture(docs.limit(0), goal).count() == 0
    assert mixture(docs, goal.limit(0)).count() == 0 and mixture_shares(docs, goal.limit(0)).count() == 0


def test_tokens(spark):
    enc = Tokenizer().load()
    texts = ["Hello world", "", "naïve <|endoftext|> text", None, "a" * 5000]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(token_count("t")).collect()]
    assert got == [None if t is None else len(enc.encode_ordinary(t)) for t in texts]
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
