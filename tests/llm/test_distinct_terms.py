import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpuslane.llm.distinct_terms import _TERM, distinctiveness, term_graph_of_lists, term_graph_of_texts


def brute(records, window):
    df = Counter(t for terms in records.values() for t in set(terms))
    out = {}
    for r, terms in records.items():
        near = defaultdict(set)
        for i, a in enumerate(terms):
            for b in terms[i + 1 : i + window]:
                if a != b:
                    near[a].add(b)
                    near[b].add(a)
        for t, n in Counter(terms).items():
            out[r, t] = (n, len(near[t]), df[t], len(near[t]) * math.log(len(records) / df[t]))
    return out


def test_equals_brute_force(spark):
    texts = {"a": "The cat, the dog; the CAT sat. On a mat", "b": "dog dog dog", "c": "ünïcode über cats123 and cat", "d": "no", "e": "", "f": "the the cat dog cat the bird " * 3}
    df = spark.createDataFrame([*texts.items(), ("g", None)], "k string, t string")
    n = spark.createDataFrame([(len(texts),)], "n_records bigint")
    got = {(r["id"], r["term"]): (r["n"], r["degree"], r["d"], r["score"]) for r in distinctiveness(term_graph_of_texts(df, "k", "t", 3), n).collect()}
    want = brute({k: _TERM.findall(t.lower()) for k, t in texts.items()}, 3)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:3] == v[:3] and math.isclose(got[k][3], v[3], abs_tol=1e-12)


def test_lists_and_condition(spark):
    lists = {"x": ["p", "q", "r"], "y": ["p"], "z": ["q", "p", "q"]}
    df = spark.createDataFrame([*lists.items(), ("n", None), ("m", [])], "k string, t array<string>")
    n = spark.createDataFrame([(3,)], "n_records bigint")
    g = term_graph_of_lists(df, "k", "t", 2)
    got = {(r["id"], r["term"]): (r["n"], r["degree"], r["d"]) for r in distinctiveness(g, n).collect()}
    assert got == {k: v[:3] for k, v in brute(lists, 2).items()}
    kept = distinctiveness(g, n, F.col("n") >= 2).collect()
    assert [(r["id"], r["term"], r["d"]) for r in kept] == [("z", "q", 2)]  # d counts all records


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, t string")
    n = spark.createDataFrame([(0,)], "n_records bigint")
    assert distinctiveness(term_graph_of_texts(df, "k", "t", 3), n).count() == 0
