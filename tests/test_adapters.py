"""Model adapters, indexes on the path from index to answer, cache-first fetching, the report."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslane import cli
from corpuslane.operators import dense, embedding, generation, metrics, ner, relations, retrieval, sparse, verification
from corpuslane.plans import pipeline
from corpuslane.sources import pubmed


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_by_bits_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert metrics.lcs(a, b) == brute_lcs(a, b)


def test_stemmer_known_values():
    want = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
            "conditional": "condit", "triplicate": "triplic", "electrical": "electr", "hopefulness": "hope", "revival": "reviv", "replacement": "replac", "adoption": "adopt", "controll": "control"}
    assert {w: metrics.stem(w) for w in want} == want


def test_rouge_and_embedding_score(spark):
    df = spark.createDataFrame([("The cats were sleeping", "the cat slept soundly"), ("", "x"), (None, None)], "h string, r string")
    r = [x[0] for x in df.select(metrics.rouge(F.col("h"), F.col("r"))).collect()]
    assert round(r[0]["rouge1"], 3) == 0.5 and r[1]["rougeL"] == 0 and r[2]["rouge2"] == 0
    plain = df.select(metrics.rouge(F.col("h"), F.col("r"), stemmed=False)).first()[0]
    assert round(plain["rouge1"], 3) == 0.25
    s = [x[0] for x in df.select(metrics.embedding_score(F.col("h"), F.col("h"), embedding.HashingProvider())).collect()]
    assert round(s[0]["f1"], 6) == 1 and s[1]["f1"] == 0 and s[2]["f1"] == 0


def test_tagger_batches_and_failures(spark):
    sizes = []

    def model(texts):
        sizes.append(len(texts))
        if any("bad" in t for t in texts):
            raise ValueError
        return [[(w, "CHEMICAL", 0, len(w), 0.9) for w in t.split()[:1]] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aspirin now", "bad", None, "", "heparin"])], "doc_id int, text string").coalesce(1)
    out = ner.tag(df, model, failed=True)
    assert ner.tag(df, model).count() == 2
    rows = sorted((r["doc_id"], r["type"], r["text"]) for r in out.where("type != 'FAILED'").collect())
    assert rows == [(0, "DRUG", "aspirin"), (4, "DRUG", "heparin")]
    assert ner.failures(out).first()["failed"] == 1 and ner.tag(df.limit(0), model).count() == 0


def test_large_dictionary_uses_the_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Heart failure and renal failure"), (2, None), (3, "nothing")], "doc_id int, text string")
    terms = spark.createDataFrame([("heart failure", "DISEASE"), ("Renal Failure", "DISEASE"), (None, "DRUG")], "term string, type string")
    want = sorted(map(tuple, ner.gazetteer(docs, terms).collect()))
    monkeypatch.setattr(ner, "DICTIONARY_BYTES", 100)
    assert sorted(map(tuple, ner.gazetteer(docs, terms).collect())) == want and len(want) == 2


def test_linking_and_tags_of_subwords(spark):
    e = spark.createDataFrame([(1, "DRUG", "Aspirin", 0, 7, 1.0), (1, "DRUG", "other", 9, 14, 1.0)], "doc_id int, type string, text string, start int, end int, confidence double")
    c = spark.createDataFrame([("aspirin", "C1", "Acetylsalicylic acid", 0.9), ("ASPIRIN ", "C2", "x", 0.5), (None, "C3", "y", 1.0)], "name string, concept_id string, canonical string, score double")
    got = {r["text"]: (r["concept_id"], r["concept_name"]) for r in ner.link(e, c).collect()}
    assert got == {"Aspirin": ("C1", "Acetylsalicylic acid"), "other": (None, None)}
    df = spark.createDataFrame([(["B-X", "O", "B-Y"], [None, 0, 0, 1, 2, 2, None]), ([], [None]), (None, None)], "tags array<string>, words array<int>")
    one = [r[0] for r in df.select(ner.align_tags(F.col("tags"), F.col("words"))).collect()]
    every = [r[0] for r in df.select(ner.align_tags(F.col("tags"), F.col("words"), True)).collect()]
    assert one == [[None, "B-X", None, "O", "B-Y", None, None], [None], None] and every[0] == [None, "B-X", "I-X", "O", "B-Y", "I-Y", None]


def test_relation_classifier(spark):
    docs = spark.createDataFrame([(1, "Aspirin and warfarin interact. Heparin alone.")], "doc_id int, text string")
    ents = spark.createDataFrame([(1, "DRUG", t) for t in ("Aspirin", "warfarin", "Heparin")], "doc_id int, type string, text string")
    pairs = relations.entity_pairs(docs, ents)
    out = relations.classify_pairs(pairs, lambda t: [("effect", 0.9) if "interact" in x else ("negative", 0.9) for x in t]).collect()
    assert [(r["subject"], r["object"], r["kind"]) for r in out] == [("Aspirin", "warfarin", "effect")]


def test_claims_of_replies(spark):
    df = spark.createDataFrame([(1, "A first sentence of some length.", 'Sure: ["one", "two"]'), (2, "A second sentence of some length.", "none"), (3, None, None)], "answer_id int, text string, reply string")
    got = sorted((r["answer_id"], r["claim_id"], r["claim"]) for r in verification.claims_from_replies(df).collect())
    assert got == [(1, 0, "one"), (1, 1, "two"), (2, 0, "A second sentence of some length.")]


def test_streaming_of_one_answer():
    class Parts:
        def stream(self, system, user):
            yield from ("a", user[-9:])

    assert "".join(generation.stream(Parts(), "q", "doc")) == "aove only.\n\n" + generation.DISCLAIMER
    assert list(generation.stream(Parts(), "q", "")) == [generation.REFUSAL]


def test_contrastive_pairs(spark):
    q = spark.createDataFrame([(1, "q1"), (2, None)], "query_id bigint, text string")
    d = spark.createDataFrame([(1, "p"), (2, "n1"), (3, "n2")], "doc_id bigint, text string")
    t = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "query_id bigint, doc_id bigint")
    n = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 2, 3)], "query_id bigint, doc_id bigint, rank int")
    assert [tuple(r) for r in embedding.contrastive_pairs(q, d, t).collect()] == [("q1", "p", None)]
    assert [tuple(r) for r in embedding.contrastive_pairs(q, d, t, n).collect()] == [("q1", "p", "n2")]


def clustered(spark, n=400, dim=8):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, dim)) * 4
    v = centre[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 0.3
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "doc_id bigint, vector array<double>")
    return df, df.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")


def test_inverted_file_probes_few_cells_where_data_clusters(spark, monkeypatch):
    v, q = clustered(spark)
    ix = dense.build_ivf(v)
    assert len(ix.centroids) == 40 and ix.probes <= len(ix.centroids) // 4
    exact = dense.flat_search(v, q, k=10)
    assert dense.recall(dense.ivf_search(ix, q, 10), exact).first()["recall"] >= 0.9
    monkeypatch.setattr(dense, "BLOCK_BYTES", 500)  # many query blocks
    assert dense.recall(dense.ivf_search(ix, q, 10), exact).first()["recall"] >= 0.9
    assert dense.build_ivf(v.limit(0)).rows.count() == 0 and dense.ivf_search(ix, q.limit(0)).count() == 0


def test_hyperplanes(spark):
    v, q = clustered(spark)
    v = v.unionByName(spark.createDataFrame([(9999, None)], v.schema))
    p = dense.Hyperplanes(8, tables=8, bits=dense.bits_for(400))
    found = dense.lsh_search(v, q, p, 10)
    exact = dense.flat_search(v, q, k=10, unit=True)
    assert dense.recall(found, exact).first()["recall"] >= 0.9
    score = {(r["query_id"], r["doc_id"]): r["score"] for r in exact.collect()}
    for r in found.collect():
        if (r["query_id"], r["doc_id"]) in score:
            assert abs(score[r["query_id"], r["doc_id"]] - r["score"]) < 2e-9
    assert dense.lsh_search(v.limit(0), q, p).count() == 0 and dense.lsh_search(v, q.limit(0), p).count() == 0


def articles(spark):
    rows = [(str(i), f"Title {w}", f"The {w} study shows that {w} reduces pain in adults. " * 8, "J", f"20{10 + i}-01-01", [w], []) for i, w in enumerate(("aspirin", "metformin", "heparin"))]
    a = spark.createDataFrame(rows, "pmid string, title string, abstract string, journal string, pub_date string, mesh_terms array<string>, authors array<string>")
    for c in ("keywords", "publication_types"):
        a = a.withColumn(c, F.array().cast("array<string>"))
    return a.withColumn("doi", F.lit(None).cast("string")).withColumn("source", F.lit("pubmed"))


@pytest.mark.parametrize("kind", ["flat", "ivf"])
@pytest.mark.parametrize("method", ["sentence", "section", "semantic"])
def test_index_is_used_as_written(spark, tmp_path, kind, method):
    s = pipeline.Settings(chunk_size=60, overlap=10, min_chunk_size=5, top_k=3, fetch=7, method=method, index_type=kind, rrf_k=10, dense_weight=0.2, sparse_weight=0.8, query_provider="hashing-64")
    pipeline.build_index(pipeline.ingest_articles(articles(spark), s), str(tmp_path / "ix"), s)
    r = pipeline.load_index(spark, str(tmp_path / "ix"))
    assert isinstance(r.vectors, dense.InvertedFile) == (kind == "ivf")
    assert (r.fetch, r.rrf_k, r.dense_weight, r.sparse_weight) == (7, 10, 0.2, 0.8) and r.query_provider.name == "hashing-64"
    q = spark.createDataFrame([(1, "metformin pain")], "query_id bigint, text string")
    top = r.retrieve(q, 3).orderBy("rank").join(r.docs.select("doc_id", F.col("text").alias("t")), "doc_id").collect()
    assert any("metformin" in x["t"] for x in top)
    assert r.retrieve(q, 3, {"pub_year_gte": 2012}).join(r.docs, "doc_id").select("pub_year").distinct().collect()[0][0] == 2012


def test_unknown_method_and_index_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown method"):
        pipeline.ingest_articles(articles(spark), pipeline.Settings(method="paragraph"))
    c = pipeline.ingest_articles(articles(spark), pipeline.Settings(min_chunk_size=5))
    with pytest.raises(ValueError, match="unknown index"):
        pipeline.build_index(c, str(tmp_path / "x"), pipeline.Settings(index_type="tree"))


def test_retriever_hooks(spark):
    docs = spark.createDataFrame([(1, "heart attack care"), (2, "renal care in adults"), (3, "other words here")], "doc_id bigint, text string")
    v = docs.select("doc_id", embedding.embed(F.col("text"), embedding.HashingProvider()).alias("vector"))
    q = spark.createDataFrame([(1, "kidney")], "query_id bigint, text string")
    r = retrieval.Retriever(docs, sparse.build(docs), v, concepts=lambda c: F.lit("renal"))
    assert r.retrieve(q, 1, mode="sparse", reranking=False).first()["doc_id"] == 2
    seen = []

    def model(pairs):
        seen.append(len(pairs))
        return [float("other" in t) for _, t in pairs]

    hits, counts = retrieval.telemetry(r.retrieve(q, 3, mode="dense", reranking=False))
    out = retrieval.rerank(hits, q, docs, 3, retrieval.cross_encoder(model, 2)).orderBy("rank").collect()
    assert out[0]["doc_id"] == 3 and counts.get["rows"] == 3 and counts.get["queries"] == 1


def test_frequent_terms_are_spread(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 7} extra{i}") for i in range(60)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "common word3"), (2, "extra5 common")], "query_id bigint, text string")
    ix = sparse.build(docs)
    want = sorted(map(tuple, sparse.search(ix, q, 5).collect()))
    monkeypatch.setattr(sparse, "QUERY_TERMS", 1)
    assert sorted(map(tuple, sparse.search(ix, q, 5).collect())) == want


def test_cache_first_fetching(spark, tmp_path):
    def fetch(ids):
        with open(tmp_path / "calls", "a") as f:
            f.write(",".join(sorted(ids)) + "\n")
        return "<PubmedArticleSet>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID></MedlineCitation></PubmedArticle>" for i in ids if i != "404") + "</PubmedArticleSet>"

    def ids(*x):
        return spark.createDataFrame([(i,) for i in x], "pmid string")

    path = str(tmp_path / "cache")
    one = pubmed.fetch_by_ids(ids("1", "2", "2", None, "404"), path, fetch, pause=0.0)
    assert sorted(r["pmid"] for r in one.collect()) == ["1", "2"]
    two = pubmed.fetch_by_ids(ids("2", "3"), path, fetch, pause=0.0)
    assert sorted(r["pmid"] for r in pubmed.parse_articles(two).collect()) == ["2", "3"]
    asked = [i for line in open(tmp_path / "calls") for i in line.strip().split(",")]
    assert sorted(asked) == ["1", "2", "3", "404"]  # 2 came from the cache
    assert pubmed.fetch_by_ids(ids().limit(0), path, fetch, pause=0.0).count() == 0


def test_report_and_benchmarks(spark, tmp_path):
    s = pipeline.Settings(chunk_size=60, overlap=10, min_chunk_size=5, top_k=3, fetch=5)
    pipeline.build_index(pipeline.ingest_articles(articles(spark), s), str(tmp_path / "ix"), s)
    r = pipeline.load_index(spark, str(tmp_path / "ix"))
    qa = spark.createDataFrame([(1, "metformin pain", "metformin reduces pain", ["pmid_1_chunk_0"]), (2, "heparin", None, [])], "query_id bigint, question string, answer string, relevant_doc_ids array<string>")
    rep = {(x["group"], x["metric"]): x["value"] for x in pipeline.report(r, qa, s, judge=embedding.HashingProvider()).collect()}
    assert {"retrieval@1", "retrieval@5", "retrieval@10", "generation", "answers"} == {g for g, _ in rep}
    assert rep["retrieval@5", "recall"] == 0.5 and rep["generation", "rouge1"] > 0 and 0 < rep["generation", "bertscore_f1"] <= 1 and "bleu" in {m for _, m in rep}
    assert {x["group"] for x in pipeline.report(r, qa, s, generate=False).collect()} == {"retrieval@1", "retrieval@5", "retrieval@10"}
    b = pipeline.benchmark("medqa", spark.createDataFrame([("A", "A"), ("It is B", "C")], "predicted string, gold string")).first()
    assert b["correct"] == 1
    with pytest.raises(ValueError, match="unknown benchmark"):
        pipeline.benchmark("x", qa)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    s = pipeline.Settings(chunk_size=60, overlap=10, min_chunk_size=5)
    pipeline.ingest_articles(articles(spark), s).write.parquet(str(tmp_path / "chunks"))
    cli.main(["build-index", "--input", str(tmp_path / "chunks"), "--output", str(tmp_path / "ix"), "--index-type", "ivf"])
    cli.main(["query", "--index", str(tmp_path / "ix"), "--top-k", "2", "metformin pain"])
    assert "metformin" in capsys.readouterr().out
