import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslane.operators import benchmarks, generation, metrics, ner, relations, verification


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_context(spark):
    rows = [(1, r, f"d{r}", "word " * n, 0.5) for r, n in enumerate((100, 100, 500, 1), 1)]
    h = spark.createDataFrame(rows, "query_id int, rank int, doc_id string, text string, score double")
    s = generation.select_context(h, 8, 300.0)
    assert sorted(r["rank"] for r in s.collect()) == [1, 2]  # no skipping ahead
    c = generation.format_context(s.withColumn("pmid", F.when(F.col("rank") == 1, "77")).withColumn("pub_date", F.lit("2020-Jan-01")).withColumn("note_id", F.lit("9"))).first()
    assert c["context"].startswith("[Doc 1] PMID: 77 |  (2020)\nword") and "\n---\n[Doc 2] Clinical Note: 9 | Type: unknown | Section: full_note\n" in c["context"] and c["n_citations"] == 2
    q = spark.createDataFrame([(1, "word"), (2, "other")], "query_id int, text string")
    a = {r["query_id"]: r for r in generation.generate(generation.format_context(s), q).collect()}
    assert a[2]["answer"] == generation.REFUSAL and a[2]["confidence"] == 0 and a[1]["answer"].endswith(generation.DISCLAIMER)

    class Echo:
        def generate(self, system, user):
            return [f"low confidence {len(u)}" for u in user]

    b = generation.generate(generation.format_context(s), q, "literature_synthesis", Echo(), 0.5).where("query_id = 1").first()
    assert b["answer"] == generation.REFUSAL and b["confidence"] == 0.35


def test_answer_reads_the_whole_text(spark):
    long = "Renal function " + "was measured again and " * 20 + "aspirin stopped the bleeding. Next one."
    rows = [(1, 1, "d1", long, 0.5), (1, 2, "d2", None, 0.4)]
    h = spark.createDataFrame(rows, "query_id int, rank int, doc_id string, text string, score double")
    q = spark.createDataFrame([(1, "aspirin bleeding")], "query_id int, text string")
    a = generation.generate(generation.format_context(generation.select_context(h)), q, least_confidence=0.8).first()
    assert a["answer"].startswith(long.removesuffix(" Next one.") + " [Doc 1]") and a["confidence"] == 0.85
    assert len(a["citations"][0]["snippet"]) == 200


def test_confidence(spark):
    d = docs(spark, "Confidence level: Medium", "nothing", "we cannot answer", "HIGH confidence")
    assert [r[0] for r in d.orderBy("doc_id").select(generation.confidence(F.col("text"))).collect()] == [0.6, 0.7, 0.1, 0.85]


def test_claims_and_faithfulness(spark):
    a = spark.createDataFrame([(1, "Aspirin reduces pain in adults. Note: see below please. Short. Confidence level: high now. It is not safe in small children. ⚕️ Clinical Disclaimer: x y z."), (2, ""), (3, None)], "answer_id int, text string")
    c = verification.claims(a)
    assert [(r["claim_id"], r["claim"]) for r in c.orderBy("claim_id").collect()] == [(0, "Aspirin reduces pain in adults."), (4, "It is not safe in small children.")]
    p = spark.createDataFrame([(1, 1, "aspirin reduces pain in adults. always"), (1, 2, "it is safe in small children. indeed")], "answer_id int, passage_id int, text string")
    v = verification.verify(c, p)
    assert {r["claim_id"]: (r["label"], r["passage_id"]) for r in v.collect()} == {0: ("entailment", 1), 4: ("contradiction", None)}
    f = {r["answer_id"]: (r["claims"], r["supported"], r["contradicted"], r["faithfulness"]) for r in verification.faithfulness(v, a).collect()}
    assert f == {1: (2, 1, 1, 0.5), 2: (0, 0, 0, 1.0), 3: (0, 0, 0, 1.0)}
    assert verification.blocked(verification.faithfulness(v, a), 0.6).where("blocked").count() == 1
    ctx = p.withColumn("n", F.col("passage_id"))
    cited = a.withColumn("text", F.lit("[Doc 1] and [Doc 1] and [Doc 2] or [Doc 7]"))
    acc = {r["answer_id"]: r["accuracy"] for r in verification.citation_accuracy(cited, ctx, v).collect()}
    assert acc[1] == 0.5 and verification.citation_accuracy(a, ctx, v).where("accuracy < 1").count() == 0
    s = p.withColumnRenamed("passage_id", "sample_id")
    assert verification.self_consistency(c, s, agreement=0.5).first()["score"] == 0.5
    j = docs(spark, 'Here: ["one", " ", "two"] ok', "none").orderBy("doc_id").select(verification.claims_from_json(F.col("text"))).collect()
    assert j[0][0] == ["one", "two"] and not j[1][0]


def brute_gazetteer(text, terms):
    w = [m.span() for m in re.finditer(r"[^\W_]+(?:[-'][^\W_]+)*", text)]
    out = set()
    for i in range(len(w)):
        for k in range(i, len(w)):
            if k > i and text[w[k - 1][1] : w[k][0]] != " ":
                break
            s = text[w[i][0] : w[k][1]]
            if s.lower() in terms:
                out.add((terms[s.lower()], s, w[i][0], w[k][1]))
    return out


def test_gazetteer(spark, monkeypatch):
    texts = ["Renal pain, renal  pain and RENAL PAIN.", "painful renal-pain", "", None, "ünal renal pain"]
    terms = {"renal pain": "DISEASE", "pain": "SYMPTOM", "ünal": "DRUG"}
    t = spark.createDataFrame([("Renal pain", "DISEASE"), ("renal pain ", "DISEASE"), ("pain", "SYMPTOM"), ("Ünal", "DRUG"), (None, "X")], "term string, type string")
    want = {(i, *x) for i, s in enumerate(texts) if s for x in brute_gazetteer(s, terms)}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(ner, "DICTIONARY_BYTES", limit)
        got = {(r["doc_id"], r["type"], r["text"], r["start"], r["end"]) for r in ner.gazetteer(docs(spark, *texts), t).collect()}
        assert got == want
    kept = ner.ensemble([ner.gazetteer(docs(spark, texts[0]), t)]).orderBy("start").collect()
    assert [r["text"] for r in kept] == ["Renal pain", "renal", "RENAL PAIN"] or [(r["start"], r["end"]) for r in kept] == [(0, 10), (19, 23), (28, 38)]
    assert ner.gazetteer(docs(spark, *texts), t.limit(0)).count() == 0


def test_overlaps_and_spans(spark):
    e = spark.createDataFrame([(1, "A", "a", 0, 5, 0.9), (1, "A", "b", 3, 8, 0.95), (1, "B", "c", 8, 10, 0.5)], "doc_id int, type string, text string, start int, end int, confidence double")
    assert [(r["start"], r["end"]) for r in ner.resolve_overlaps(e).orderBy("start").collect()] == [(3, 8), (8, 10)]
    assert {(r["type"], tuple(r["texts"])) for r in ner.by_type(e).collect()} == {("A", ("a", "b")), ("B", ("c",))}
    tags = ["O", "B-DRUG", "I-DRUG", "I-GENE", "B-DRUG", "B-DRUG", "I-DRUG"]
    t = spark.createDataFrame([(1, i, f"t{i}", x) for i, x in enumerate(tags)], "doc_id int, pos int, token string, tag string")
    assert [(r["first"], r["last"], r["type"]) for r in ner.bio_spans(t).orderBy("first").collect()] == [(1, 2, "DRUG"), (3, 3, "GENE"), (4, 4, "DRUG"), (5, 6, "DRUG")]

    def model(texts):
        if "bad" in texts[0]:
            raise ValueError
        return [[(m.group(), "CHEMICAL", m.start(), m.end(), 0.9) for m in re.finditer("aspirin", t)] for t in texts]

    assert [(r["doc_id"], r["type"], r["start"]) for r in ner.tag(docs(spark, "an aspirin", "bad", None), model).collect()] == [(0, "DRUG", 3)]


def test_relations(spark):
    d = docs(spark, "Fluconazole increases plasma levels of warfarin.", "Metformin may cause lactic acidosis.", "BRCA1 mutations are associated with breast cancer risk today.", None,
             "We found no evidence. Aspirin caused gastric bleeding. Done.", "He had no Aspirin caused gastric bleeding.")
    x = relations.drug_interactions(d).collect()
    assert [(r["subject"], r["object"], r["kind"], r["confidence"]) for r in x] == [("Fluconazole", "warfarin", "mechanism", 0.7)]
    a = {r["doc_id"]: r for r in relations.adverse_reactions(d).collect()}
    assert (a[1]["subject"], a[1]["object"], a[1]["speculative"], round(a[1]["confidence"], 6)) == ("Metformin may", "lactic acidosis", True, 0.6)
    assert 4 not in a or a[4]["evidence"] == "Aspirin caused gastric bleeding."
    assert 5 in {r["doc_id"] for r in relations.adverse_reactions(d, negated=True).collect()}
    g = relations.gene_diseases(d, strict_gene=True).first()
    assert (g["subject"], g["object"]) == ("BRCA1", "breast cancer risk today")
    assert relations.graph_edges(relations.all_relations(d)).where("relation = 'drug_interaction'").count() == 1


def test_overlap_metrics(spark):
    p = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b", "c d e"), (3, None, "x")], "id int, hypothesis string, reference string")
    b = metrics.bleu(p.where("id = 1")).first()
    assert b["bleu"] == pytest.approx(1.0) and metrics.bleu(p).first()["n"] == 2 and metrics.bleu(p.limit(0)).first()["bleu"] in (0.0, None)
    r = p.select("id", metrics.rouge_sets(F.col("hypothesis"), F.col("reference")).alias("r"), metrics.rouge(F.col("hypothesis"), F.col("reference")).alias("f")).orderBy("id").collect()
    assert r[0]["r"]["rouge1"] == 1 and r[1]["r"]["rouge1"] == 0 and r[0]["f"]["rouge2"] == 1 and r[0]["f"]["rougeL"] == 1
    assert metrics.lcs(list("ABCBDAB"), list("BDCABA")) == 4
    s = spark.createDataFrame([("cat mat", "The cat is here on a large mat today.", ["the cat sat", "dogs bark"], "cat bird")], "q string, a string, p array<string>, t string")
    x = s.select(metrics.answer_scores(*[F.col(c) for c in "qapt"]).alias("s")).first()["s"]
    assert (x["faithfulness"], x["relevance"], x["context_recall"], x["context_precision"]) == (1.0, 1.0, 0.5, 0.5) and x["overall"] == pytest.approx(4 / 6)
    assert [v[0] for v in docs(spark, "score 0.75!", "1.0", "none", "1").orderBy("doc_id").select(metrics.parse_score(F.col("text"))).collect()] == [0.75, 1.0, 0.5, 1.0]


def test_benchmark_scores(spark):
    b = spark.createDataFrame([("yesno", "Yes, it is", ["no"]), ("yesno", "well, no.", ["No"]), ("factoid", "It is Aspirin", ["aspirin"]), ("list", "- A\n- b\n", ["a", "c"]), ("summary", "a b", ["a c"]), ("list", None, ["x"])], "type string, predicted string, gold array<string>")
    assert {r["type"]: (r["score"], r["n"]) for r in benchmarks.bioasq(b).collect()} == {"yesno": (0.5, 2), "factoid": (1.0, 1), "list": (0.5, 1), "summary": (0.5, 1)}
    li = docs(spark, "1. one\n2. two", "plain", "• x").orderBy("doc_id").select(benchmarks.list_items(F.col("text"))).collect()
    assert [x[0] for x in li] == [["one", "two"], ["plain"], ["x"]]
    m = spark.createDataFrame([("The answer is C.", "C"), ("none", "a"), (None, "B")], "predicted string, gold string")
    assert tuple(benchmarks.choice_accuracy(m).first())[1:] == (2, 3)
    pred = spark.createDataFrame([(1, "Pain", "DISEASE"), (1, "pain", "DISEASE"), (1, "x", "DRUG")], "doc_id int, text string, type string")
    gold = spark.createDataFrame([(1, "pain", "problem"), (1, "cbc", "test"), (1, "pain", "problem")], "doc_id int, text string, type string")
    r = {x["type"]: (x["tp"], x["fp"], x["fn"]) for x in benchmarks.entity_prf(pred, gold).collect()}
    assert r == {"DISEASE": (2, 0, 0), "DRUG": (0, 1, 0), "LAB_VALUE": (0, 0, 1), "all": (2, 1, 0), "micro_all": (2, 1, 1)}
    assert Counter(x[0] for x in docs(spark, "Yes it", "so no, really", "hm").select(benchmarks.answer_label(F.col("text"))).collect()) == Counter(["yes", "no", "maybe"])
