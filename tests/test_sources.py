import datetime
import json

import pytest
from pyspark.sql import functions as F

from corpuslane.plans import pipeline
from corpuslane.session import materialize, release, small
from corpuslane.sources import files, pubmed
from corpuslane.streaming import audit

XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">111</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Jan</Month></PubDate></JournalIssue><Title>J One</Title></Journal>
<ArticleTitle>A title &amp; more</ArticleTitle><Abstract><AbstractText Label="BACKGROUND">Some <i>nested</i> text.</AbstractText><AbstractText>Second.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Solo</LastName></Author></AuthorList>
<PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName>Heart</DescriptorName><QualifierName>surgery</QualifierName><QualifierName>injuries</QualifierName></MeshHeading><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList>
<KeywordList><Keyword>k1</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><Article><ArticleTitle>no id</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = pubmed.read_xml(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["pmid"], r["title"], r["abstract"], r["journal"], r["pub_date"], r["doi"], r["pmc_id"]) == ("111", "A title & more", "BACKGROUND: Some nested text. Second.", "J One", "2020-Jan-01", "10.1/x", None)
    assert r["authors"] == ["Doe, Jane", "Solo"] and r["mesh_terms"] == ["Heart/surgery", "Heart/injuries", "Humans"] and r["keywords"] == ["k1"] and r["publication_types"] == ["Review"]
    d = pubmed.to_documents(pubmed.read_xml(spark, str(tmp_path))).first()
    assert d["doc_id"] == "pmid_111" and d["text"] == "Title: A title & more\n\nAbstract: BACKGROUND: Some nested text. Second." and d["pub_year"] == 2020
    assert pubmed.by_mesh(pubmed.read_xml(spark, str(tmp_path)), "heart", 2019, 2021).count() == 1
    assert pubmed.mesh_query("Heart", 2000, 2001) == '"Heart"[MeSH Terms] AND 2000:2001[PDAT]'


def test_paged_source(spark):
    def search(query):
        return 5

    def fetch(query, start, size):
        return f"{query}:{start}:{size}"

    spark.dataSource.register(pubmed.paged_source(search, fetch))
    rows = spark.read.format("literature").options(query="q", batch_size=2, pause=0).load().orderBy("start").collect()
    assert [r["xml"] for r in rows] == ["q:0:2", "q:2:2", "q:4:1"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert pubmed.with_retry(flaky, 3, 0.0)() == 7
    with pytest.raises(OSError):
        pubmed.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0.0)()


def test_cache_and_first_wins(spark):
    now = datetime.datetime.now()
    c = spark.createDataFrame([("a", now), ("b", now - datetime.timedelta(hours=80))], "key string, fetched_at timestamp")
    assert [r["key"] for r in pubmed.fresh(c).collect()] == ["a"]
    a = spark.createDataFrame([("1", 5), ("1", 3), ("2", 1)], "pmid string, pos int")
    b = spark.createDataFrame([("2", 0), ("3", 9)], "pmid string, pos int")
    assert {tuple(r) for r in pubmed.first_wins([a, b], "pmid", "pos").collect()} == {("1", 3, 0), ("2", 1, 0), ("3", 9, 1)}


def test_note_csv(spark, tmp_path):
    head = "ROW_ID,SUBJECT_ID,HADM_ID,CHARTDATE,CHARTTIME,STORETIME,CATEGORY,DESCRIPTION,CGID,ISERROR,TEXT\n"
    (tmp_path / "n.csv").write_text(head + '1,2,3,2101-01-01,,,Nursing,d,,,"He said ""hi"",\nthen left"\n2,2,,2101-01-01,,,Nursing,d,,1,"x"\n3,2,,2101-01-01,,,Nursing,d,,,""\n')
    n = files.read_notes_csv(spark, str(tmp_path / "n.csv"))
    assert n.orderBy("row_id").first()["text"] == 'He said "hi",\nthen left'
    assert tuple(files.note_counters(n).first()) == (3, 1, 1, 1)


def test_json_formats(spark, tmp_path):
    d = tmp_path / "docs" / "sub"
    d.mkdir(parents=True)
    (d / "a.jsonl").write_text(json.dumps({"id": "x", "text": "t", "metadata": {"k": 1}}) + "\n" + json.dumps({"chunk_id": "c", "text": "u", "metadata": {}}) + "\n")
    docs = files.read_documents(spark, str(tmp_path / "docs"))
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == {("x", "t"), ("c", "u")}
    files.write_documents(docs.select("doc_id", "text"), str(tmp_path / "out"))
    assert files.read_documents(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"id": "1", "type": "list", "body": "q", "ideal_answer": ["i"], "exact_answer": "e", "documents": ["d"]}, {"id": "2", "type": "yesno", "body": "q"}]}))
    b = files.read_bioasq(spark, str(tmp_path / "b.json")).orderBy("id").collect()
    assert (b[0]["exact"], b[0]["ideal"], b[1]["exact"]) == (["e"], ["i"], None)
    (tmp_path / "p.json").write_text(json.dumps({"77": {"QUESTION": "q", "CONTEXTS": ["a", "b"], "LABELS": [], "LONG_ANSWER": "l", "final_decision": "yes"}, "78": {"QUESTION": "r", "CONTEXTS": []}}))
    assert {(r["pmid"], r["label"]) for r in files.read_pubmedqa(spark, str(tmp_path / "p.json")).collect()} == {("77", "yes"), ("78", "maybe")}
    (tmp_path / "m.jsonl").write_text(json.dumps({"question": "q", "options": {"A": "x"}, "answer": "x"}) + "\n")
    assert files.read_medqa(spark, str(tmp_path / "m.jsonl")).first()["gold"] == "x"
    (tmp_path / "q.jsonl").write_text(json.dumps({"question": "q", "answer": "a", "relevant_doc_ids": ["1"]}) + "\n")
    assert files.read_qa(spark, str(tmp_path / "q.jsonl")).first()["relevant_doc_ids"] == ["1"]
    (tmp_path / "n.jsonl").write_text(json.dumps({"tokens": ["a", "b"], "ner_tags": [3, 99]}) + "\n")
    assert [r["tag"] for r in files.read_ner(spark, str(tmp_path / "n.jsonl")).orderBy("pos").collect()] == ["B-DRUG", "O"]
    i = tmp_path / "i2b2"
    i.mkdir()
    (i / "x.txt").write_text("pain text")
    (i / "x.con").write_text('c="pain" 1:0 1:0||t="problem"\nbroken\n')
    (i / "y.txt").write_text("no annotations")
    t, g = files.read_i2b2(spark, str(i))
    assert [tuple(r) for r in t.collect()] == [("x", "pain text")] and [(r["doc_id"], r["text"], r["type"]) for r in g.collect()] == [("x", "pain", "problem")]
    files.write_manifest(spark, str(tmp_path / "man"), model_name="m", num_documents=3)
    assert files.read_manifest(spark, str(tmp_path / "man"))["num_documents"] == 3
    (tmp_path / "s.json").write_text('{"chunking": {"chunk_size": 99}, "retrieval": {"top_k": 3}}')
    s = pipeline.Settings.of(files.read_settings(str(tmp_path / "s.json")))
    assert s.chunk_size == 99 and s.top_k == 3


def test_written_tables(spark):
    d = materialize(spark.range(10), "t")
    assert d.count() == 10 and "broadcast" in small(d, 8)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(d, 8, 20)._jdf.queryExecution().logical().toString().lower()
    release(d)


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, i % 24, 0), i % 3, "k", 1.0) for i in range(48)], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    ev.write.parquet(str(tmp_path / "ev"))
    st = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    for name, df, mode in (("w", audit.windowed_counts(st, "6 hours"), "complete"), ("r", audit.running_totals(st), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r["n"] for r in spark.table("w").collect()} == {12}
    assert {(r["user_id"], r["n"], r["total"]) for r in spark.table("r").collect()} == {(k, 16, 16.0) for k in range(3)}
    notes = spark.createDataFrame([(1, "Nursing", "Call 617-555-0192 now", None), (2, "Nursing", "x", "1")], "row_id bigint, category string, text string, iserror string")
    notes.write.parquet(str(tmp_path / "notes"))
    s = spark.readStream.schema(notes.schema).parquet(str(tmp_path / "notes"))
    for _ in range(2):
        audit.ingest_notes(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["row_id"], r["deidentified"], r["phi_count"]) for r in out] == [(1, "Call [REDACTED] now", 1)]


def test_pipeline(spark, tmp_path):
    arts = spark.createDataFrame(
        [(str(i), f"Title {w}", f"The {w} study shows that {w} reduces pain in adults. " * 8, "J", f"20{10 + i}-01-01", [w], []) for i, w in enumerate(("aspirin", "metformin", "heparin"))],
        "pmid string, title string, abstract string, journal string, pub_date string, mesh_terms array<string>, authors array<string>",
    )
    for c in ("keywords", "publication_types"):
        arts = arts.withColumn(c, F.array().cast("array<string>"))
    arts = arts.withColumn("doi", F.lit(None).cast("string")).withColumn("source", F.lit("pubmed"))
    s = pipeline.Settings(chunk_size=60, overlap=10, min_chunk_size=5, top_k=3, fetch=5)
    pipeline.build_index(pipeline.ingest_articles(arts, s), str(tmp_path / "ix"), s)
    r = pipeline.load_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "metformin pain"), (2, None)], "query_id bigint, text string")
    a = {x["query_id"]: x for x in pipeline.answer(r, q, s, check=True).collect()}
    assert "metformin" in a[1]["answer"] and a[1]["faithfulness"] > 0 and a[2]["confidence"] == 0
    rev = pipeline.literature_review(r, q.where("query_id = 1"), first=2012, last=2012, s=s).first()
    assert "heparin" in rev["answer"] and "metformin" not in rev["answer"]
    qa = spark.createDataFrame([(1, "metformin pain", "metformin reduces pain", ["x"])], "query_id bigint, question string, answer string, relevant_doc_ids array<string>")
    assert pipeline.evaluate(r, qa, s).first()["n"] == 1
    assert pipeline.adverse_events(r, q, s).count() >= 0
    notes = spark.createDataFrame([(5, "Physician", "2020-01-01", "Plan:\nWrite to a.b@clinic.org and begin heparin for the patient now. " * 4, None)], "row_id bigint, category string, chartdate string, text string, iserror string")
    c = pipeline.ingest_notes(notes, s).collect()
    assert c and all("clinic.org" not in x["text"] for x in c) and c[0]["doc_id"] == "note_5_0_plan"
