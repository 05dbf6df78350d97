import itertools
import math

import numpy as np
import pytest

from corpuslane.llm.split_items import KINDS, PENALTY, SplitParams, boundary_kinds, cut_text, plan_cuts, split_oversized

SMALL = SplitParams(max_tokens=13, overlap_tokens=3)  # at most 10 words, 3 shared


def test_limits_of_words():
    p = SplitParams()
    assert math.floor(1.3 * p.max_words) <= 512 < math.floor(1.3 * (p.max_words + 1))
    assert math.floor(1.3 * p.overlap_words) <= 64 < math.floor(1.3 * (p.overlap_words + 1))


@pytest.mark.parametrize("n", [1, 10, 11, 25, 400, 2000])
@pytest.mark.parametrize("sep", [" ", ". ", ".\n\n", "\n", " x, "])
def test_pieces_cover_the_text_and_keep_the_limit(n, sep):
    text = "  " + sep.join(f"Word{i}" for i in range(n)) + " \n"
    pieces = cut_text(text, SMALL)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    back = text[: pieces[0][1]]
    for (_, e0, *_), (s1, e1, t1, lap, _) in itertools.pairwise(pieces):
        assert s1 <= e0 < e1
        assert t1 <= 13 and 0 <= math.floor(1.3 * lap) <= 3
        back += text[e0:e1]
    assert back == text


def test_cuts_at_sentences_where_there_are_any():
    text = " ".join(f"Alpha beta gamma delta {i}." for i in range(60))
    assert {k for *_, k in cut_text(text, SMALL)[:-1]} == {"sentence"}
    para = "\n\n".join("One two three four five six seven." for _ in range(5))
    assert {k for *_, k in cut_text(para, SMALL)[:-1]} == {"paragraph"}


def test_abbreviations_end_no_sentence():
    t = "Seen by Dr. Smith today. Fine."
    import re

    s, e = (np.array(x) for x in zip(*[m.span() for m in re.finditer(r"\S+", t)]))
    kinds = [KINDS[k] for k in boundary_kinds(t, s, e)]
    assert kinds[2] == "word" and kinds[4] == "sentence" and kinds[-1] == "end"


def test_dynamic_programme_is_optimal():
    rng = np.random.default_rng(1)
    p = SplitParams(max_tokens=7, overlap_tokens=0)  # at most 6 words, nothing shared
    for _ in range(60):
        n = int(rng.integers(7, 13))
        kinds = rng.choice([0, 1, 1, 4], n).astype(np.int8)
        kinds[-1] = 5
        got = plan_cuts(kinds, p)
        pieces = math.ceil(n / p.max_words)
        even = n / pieces

        def cost(ends, kinds=kinds, even=even, n=n):
            a, c = 0, 0.0
            for e in ends:
                if e - a > p.max_words:
                    return math.inf
                c += p.balance * ((e - a - even) / even) ** 2 + (0 if e == n else PENALTY[kinds[e - 1]]) + 1e-6
                a = e
            return c

        best = min(cost([*c, n]) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert abs(cost([b for _, b in got]) - best) < 1e-9


def test_operator_defined_cases(spark):
    long = "été " * 500
    rows = [(1, long, "a", 7), (2, None, "b", 7), (3, "", "c", 7), (4, "short text", None, 7), (1, long, "a", 7), (5, "x" * 9000, "d", 7)]
    df = spark.createDataFrame(rows, "id bigint, text string, extra string, piece_index int")
    out = split_oversized(df, "text").orderBy("id", "piece_index").collect()
    assert {r["id"] for r in out} == {1} and len(out) == 4  # the repeated row gives its pieces again
    for r in out:
        assert r["piece"] == long[r["char_start"] : r["char_end"]] and r["token_count"] <= 512 and r["extra"] == "a"
    assert split_oversized(df.limit(0), "text").count() == 0
