import os

import pandas as pd
import pytest

from corpuslane.llm import spam
from corpuslane.llm.spam import list_blocks, page_evidence, spam_pages

PROSE = "The committee reviewed the results of the trial and found no difference between the groups. Patients were followed for two years by their own doctors. " * 4
SPAM = {
    1: "\n".join(f"[Shop item{i}](https://cheap-{i}.example/a/b-{i})" for i in range(30)),
    2: " ".join(f"#tag{i % 7} #buy #cheap" for i in range(40)),
    3: " | ".join(["buy pills", "cheap pills online", "pills no prescription", "best pills"] * 15),
    4: "\n".join(f"pill{i} 20 mg tabs SKU{10000 + i} {i}.99" for i in range(30)),
    5: "\n".join(f"http://www.site-{i}.example/x/{i}" for i in range(30)),
    6: "Kaufen Pillen günstig " * 40,
    8: " - ".join(f"Top 100 cheap Contact pill{i % 3}" for i in range(30)),
    9: "\n".join(f"{a} en ligne {b} pillule" for a in ("Shop", "Home", "News", "Forum") for b in ("Top 100", "Offers", "Archive")),
    7: " ".join(f'<a href="https://site.test/p{i}">offer pill{i}</a>' for i in range(20)),
}
FINE = {
    21: PROSE,
    22: "Medication\n" + "\n".join(f"drugname{i} {i}.5 mg twice daily, after lunch" for i in range(25)),
    23: "Test\tResult\tUnit\tRange\n" + "\n".join(f"glucose\t{i}.1\tmg\t1-9" for i in range(25)),
    24: "References\n" + "\n".join(f"{i}. Smith A, Jones B. A study of many things in people. 20{10 + i % 10};{i}:{i}12. https://doi.example/10.5555/{i}" for i in range(1, 25)),
    25: "\n".join(f"Term{i}: a word that is used by doctors for condition number {i}" for i in range(20)),
    29: "Further reading\n" + "\n".join(f"Another study of number {i} was seen as the best of its year. See https://library.example/pain/{i} for the full report." for i in range(20)),
    26: "", 27: "  \n\n ", 28: "Home | News | Shop\n" + PROSE,
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, t, f"host{i % 3}") for i, t in (SPAM | FINE).items()]
    rows += [(100 + i, t, f"host{(i + 1) % 3}") for i, t in SPAM.items()]
    rows += [(200, None, "host1"), (201, SPAM[3] + "\n\n" + PROSE * 4, None), (202, SPAM[3] * 4 + "\n\n" + PROSE, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_spam_and_look_alikes(pages):
    got = {r["doc_id"] for r in spam_pages(pages).collect()}
    assert got == set(SPAM) | {100 + i for i in SPAM} | {202}


def test_characters(pages):
    r = {x["doc_id"]: x for x in page_evidence(pages).collect()}
    assert 0.9 * len(SPAM[1]) <= r[1]["spam_chars"] <= len(SPAM[1]) and r[201]["spam_chars"] * 2 < r[201]["n_chars"]
    assert not list_blocks(PROSE) and not list_blocks(FINE[22])


def test_empty_table(pages):
    assert spam_pages(pages.limit(0)).count() == 0


def test_tabs_and_short_pages(spark):
    rows = [
        (1, "a.example | b.example | c.example", "a"),
        (2, "\n".join(f"http://a{i}.example/x\thttp://b{i}.example/y" for i in range(9)), "a"),
        (3, "#buy #cheap #pills", "b"), (4, "Open daily.", "b"), (5, PROSE, "b"), (6, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in spam_pages(df).collect()} == {1, 2, 3}


def test_quick_exit_changes_nothing(monkeypatch):
    """The patterns that ``_may_link`` and ``_may_sell`` skip match nothing, over a whole table."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    segs = [t[a:b] for t in pd.read_parquet(path, columns=["text"]).text.dropna() for a, b in spam._split(t)]
    segs += [t[a:b] for t in (SPAM | FINE).values() for a, b in spam._split(t)]
    quick = [(spam._sentence(s), spam._exempt(s)) for s in segs]
    monkeypatch.setattr(spam, "_may_link", lambda seg, low: True)
    monkeypatch.setattr(spam, "_may_sell", lambda low: True)
    assert quick == [(spam._sentence(s), spam._exempt(s)) for s in segs]
