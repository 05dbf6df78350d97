import random
from collections import Counter, defaultdict

import pytest

from corpuslane.llm import forest
from corpuslane.llm.forest import dense_rank_by, spanning_forest
from corpuslane.llm.splits import assign_splits, dealing_pattern, linked_subjects

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(up):
        out[find(x)].add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("limit", [forest.LIMIT, 0])  # pointers by broadcast, and frequent roots apart from the others
@pytest.mark.parametrize("kind", ["random", "path", "star", "cycle"])
def test_forest(spark, kind, limit, monkeypatch):
    monkeypatch.setattr(forest, "LIMIT", limit)
    monkeypatch.setattr(forest, "HOT", 5)
    rng = random.Random(4)
    n = 120
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(90)], "path": [(i, i + 1) for i in range(n)],
        "star": [(0, i) for i in range(1, n)], "cycle": [(i, (i + 1) % n) for i in range(n)],
    }[kind]
    rows = [*edges, edges[0], (7, 7), (None, 3)]
    trees, labels = spanning_forest(spark.createDataFrame(rows, "a bigint, b bigint"))
    want = components([(a, b) for a, b in edges if a != b])
    got = defaultdict(set)
    for r in labels.collect():
        got[r["root"]].add(r["v"])
    assert {frozenset(v) for v in got.values()} == want and all(k in v for k, v in got.items())
    f = [tuple(r) for r in trees.collect()]
    assert len(f) == sum(len(c) - 1 for c in want) and components(f) == want
    assert {frozenset(e) for e in f} <= {frozenset(e) for e in edges}


def test_empty_forest(spark):
    trees, labels = spanning_forest(spark.createDataFrame([], "a bigint, b bigint"))
    assert trees.count() == 0 and labels.count() == 0


def notes(n=3000, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice([None, 0, 1, 1, 1, *range(2, 400)])  # subject 1 is hot
        h = rng.choice([None, 0, *range(10_000, 14_000)])
        rows.append((i, s, h, "x"))
    return rows


def test_ties_and_shares(spark):
    rows = notes()
    df = spark.createDataFrame(rows, "row_id bigint, subject_id bigint, hadm_id bigint, component string")
    out = {r["row_id"]: r for r in assign_splits(df, SHARES).collect()}
    assert len(out) == len(rows)
    split = defaultdict(set)
    for i, s, h, _ in rows:
        for k in (("s", s) if s else None, ("h", h) if h else None):
            if k:
                split[k].add(out[i]["split"])
    assert all(len(v) == 1 for v in split.values())
    real = components([(("r", i), k) for i, s, h, _ in rows for k in ((("s", s),) if s else ()) + ((("h", h),) if h else ())])
    by = defaultdict(set)
    for i, r in out.items():
        by[r["component"]].add(i)
    tied = {frozenset(x[1] for x in c if x[0] == "r") for c in real}
    alone = {frozenset([i]) for i, s, h, _ in rows if not s and not h}
    assert {frozenset(v) for v in by.values()} == tied | alone
    assert all(len(v) == out[next(iter(v))]["component_rows"] for v in by.values())
    assert linked_subjects(df).count() == sum(k * (k - 1) // 2 for c in real for k in [sum(x[0] == "s" for x in c)])


def test_shares_are_met_among_small_components(spark):
    df = spark.createDataFrame([(i, i // 2 + 1, None) for i in range(20_000)], "row_id bigint, subject_id bigint, hadm_id bigint")
    n = Counter(r["split"] for r in assign_splits(df, SHARES).collect())
    for k, v in SHARES.items():
        assert abs(n[k] / 20_000 - v) < 0.002
    again = Counter(r["split"] for r in assign_splits(df.repartition(3), SHARES).collect())
    assert again == n


def test_empty_and_single(spark):
    schema = "row_id bigint, subject_id bigint, hadm_id bigint"
    assert assign_splits(spark.createDataFrame([], schema), SHARES).count() == 0
    one = spark.createDataFrame([(i, 5, None) for i in range(10)], schema)
    assert {r["split"] for r in assign_splits(one, SHARES).collect()} == {"train"}


def test_pattern_and_ranks(spark):
    p = dealing_pattern([0.7, 0.2, 0.1])
    for n in (10, 137, 1000):
        c = Counter(p[:n])
        assert all(abs(c[k] - s * n) <= 1 for k, s in enumerate((0.7, 0.2, 0.1)))
    df = spark.range(500).selectExpr("id", "id % 3 as s")
    r = dense_rank_by(df, "s", ["id"]).orderBy("rank0").collect()
    assert [x["rank0"] for x in r] == list(range(500)) and [x["s"] for x in r] == sorted((x["s"] for x in r), reverse=True)
