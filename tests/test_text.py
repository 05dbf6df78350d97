import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslane.functions import text as tx
from corpuslane.operators import deid, sections


def col(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_goldens(spark):
    assert col(spark, tx.token_estimate, "a b c", "", None) == [3, 0, None]
    s = col(spark, tx.sentences_biomedical, "He had symptoms. Then left.", "Done. e.g. later", "Saw Dr. Smith.", "One. Two! 3 four? five")
    assert s == [["He had symptoms. Then left."], ["Done.", "e.g. later"], ["Saw dr. Smith."], ["One.", "Two!", "3 four? five"]]
    assert col(spark, tx.sentences_plain, "a. b", "", None) == [["a.", "b"], [], None]
    assert col(spark, tx.clean_whitespace, " a  \n\n\n\nb\t\n \nc ") == ["a\n\nb\n\nc"]
    assert col(spark, tx.bm25_tokens, "The Heart-rate of 2 patients, x a1") == [["heart-rate", "a1"]]


def test_deidentify(spark):
    rows = ["Contact: 617-555-0192 or jsmith@hospital.org", "Seen by Dr. Lee in clinic today, stable.", "Give 5 mg now, or later", None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "i int, text string, phi_count string")
    out = [(r["deidentified"], r["phi_count"]) for r in deid.deidentify(df, "text").orderBy("i").collect()]
    assert out == [("Contact: [REDACTED] or [REDACTED]", 2), ("Seen by [REDACTED], stable.", 1), ("Give 5 [REDACTED] later", 1), (None, 0), ("", 0)]
    assert {r["phi_type"]: r["n"] for r in deid.audit(df, "text").collect()}["phone"] == 1
    assert col(spark, deid.contains_phi, "call 617-555-0192", "nothing", None) == [True, False, None]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB .!?\n19", max_size=40), min_size=1, max_size=8))
def test_spans_equal_finditer(spark, texts):
    p = "[ab]+[.!]?"
    got = col(spark, lambda c: tx.match_spans(c, p), *texts)
    assert [[(x["start"], x["end"]) for x in g] for g in got] == [[m.span() for m in re.finditer(p, t)] for t in texts]


def test_sections(spark):
    t = "Chief Complaint:\nChest pain radiating to left arm since morning.\nPlan:\nAdmit to telemetry and start heparin drip now.\n"
    a, b, none = col(spark, sections.segment, t, "no header here", None)
    assert [(s["section_name"], s["text"], s["start_char"]) for s in a] == [
        ("chief_complaint", "Chest pain radiating to left arm since morning.\nPlan:", 17), ("plan", "Admit to telemetry and start heparin drip now.", 71),
    ]
    assert [(s["section_name"], s["start_char"], s["end_char"]) for s in b] == [("body", 0, 14)] and none is None
    trimmed = col(spark, lambda c: sections.segment(c, trim_next=True), t)[0]
    assert trimmed[0]["text"] == "Chest pain radiating to left arm since morning."
    r = "FINDINGS:\nClear lungs.\nTECHNIQUE:\nPA view.\n"
    rows = col(spark, sections.radiology_sections, r, "none", None)
    assert [(s["section_name"], s["text"]) for s in rows[0]] == [("findings", "Clear lungs.\nTECHNIQUE:"), ("technique", "PA view.")] and rows[1] == [] and rows[2] is None
    assert col(spark, lambda c: sections.radiology_impression(sections.radiology_sections(c)), r, "none")[0].startswith("Clear lungs.")
    assert col(spark, sections.note_type, "Nursing/other", "Odd Kind", None) == ["nursing_other", "odd kind", None]


def test_note_documents(spark):
    n = spark.createDataFrame([(1, "Nursing", "a text", None), (2, "Physician ", "t", [("plan", "long enough text to be kept", 0, 5), ("x", "short", 0, 1)])],
        "row_id int, category string, text string, sections array<struct<section_name:string,text:string,start_char:int,end_char:int>>")
    out = {r["doc_id"]: (r["section"], r["note_type"]) for r in sections.note_documents(n).collect()}
    assert out == {"note_1": ("full_note", "nursing"), "note_2_0_plan": ("plan", "physician")}


@pytest.mark.parametrize("rows", [[], [(1, None, None, "1"), (2, "Nursing", " ", None), (3, "Nursing ", "t", "0")]])
def test_clean_notes(spark, rows):
    df = spark.createDataFrame(rows, "row_id int, category string, text string, iserror string")
    assert [r["row_id"] for r in sections.clean_notes(df, ["Nursing"]).collect()] == ([3] if rows else [])
