"""Sections of clinical notes and radiology reports, note types and retrieval documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions.text import match_spans

_END = r"\s*:?\s*\n"

# Headers by section, in the order that breaks ties. Case is ignored.
SECTION_HEADERS: dict[str, str] = {
    "chief_complaint": "Chief Complaint|CC",
    "history_of_present_illness": "History of Present Illness|HPI",
    "past_medical_history": "Past Medical History|PMH",
    "medications": "Medications|Current Medications|HOME MEDICATIONS",
    "allergies": "Allergies|Drug Allergies",
    "review_of_systems": "Review of Systems|ROS",
    "physical_exam": "Physical Exam(?:ination)?|PE",
    "laboratory_data": r"Laboratory(?:\s+Data)?|Labs|LAB(?:ORATORY)?(?:\s+DATA)?",
    "radiology": "Radiology|Imaging",
    "assessment": "Assessment|Impression",
    "plan": "Plan|Recommendations",
    "assessment_and_plan": "Assessment and Plan|A&P|A/P",
    "discharge_medications": "Discharge Medications",
    "discharge_instructions": "Discharge Instructions?",
    "followup": r"Follow(?:-|\s)?up|Disposition",
}
RADIOLOGY_HEADERS = ("examination", "indication", "technique", "comparison", "findings", "impression")

# Note categories; they have to be these for equal types.
NOTE_TYPES = {
    "Discharge summary": "discharge_summary", "Radiology": "radiology", "Nursing": "nursing", "Nursing/other": "nursing_other",
    "Physician": "physician", "ECG": "ecg", "Echo": "echo", "Respiratory": "respiratory", "Nutrition": "nutrition", "Rehab Services": "rehab",
    "Social Work": "social_work", "Case Management": "case_management", "Pharmacy": "pharmacy", "Consult": "consult", "General": "general",
}
SECTIONED = ("Discharge summary", "Physician")


def note_type(category: Column) -> Column:
    """The short name of a category: from the table, else its lower case."""
    table = F.create_map(*[F.lit(x) for kv in NOTE_TYPES.items() for x in kv])
    return F.coalesce(table[category], F.lower(category))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _slices(text: Column, bounds: Column, trim_next: bool) -> Column:
    """Bounds sorted by (end of header, order) to sections that run to the end of the next header, or to its start."""
    last = F.struct(F.length(text).alias("end"), F.lit(10**6).alias("ord"), F.lit("").alias("name"), F.length(text).alias("start"))
    nxt = F.slice(F.concat(F.slice(bounds, 2, 1_000_000), F.array(last)), 1, F.size(bounds))
    stop = "start" if trim_next else "end"
    return F.zip_with(
        bounds, nxt,
        lambda a, b: F.struct(
            a["name"].alias("section_name"),
            _strip(F.substring(text, a["end"] + 1, b[stop] - a["end"])).alias("text"),
            a["end"].alias("start_char"),
            b[stop].alias("end_char"),
        ),
    )


def _bounds(spans: Column, order: int, name: str) -> Column:
    return F.transform(spans, lambda m: F.struct(m["end"].alias("end"), F.lit(order).alias("ord"), F.lit(name).alias("name"), m["start"].alias("start")))


def segment(text: Column, min_length: int = 30, trim_next: bool = False) -> Column:
    """The sections of a note: array of (section_name, text, start_char, end_char).

    A section begins where its header ends and runs to the end of the next header, so it closes with that
    header's words (``trim_next`` cuts them off). Text before the first header belongs to no section;
    sections under ``min_length`` characters are dropped; a note without headers, or whose sections are
    all too short, is one ``body``. Null gives null.
    """
    found = [_bounds(match_spans(text, f"(?i)(?:{p}){_END}"), i, k) for i, (k, p) in enumerate(SECTION_HEADERS.items())]
    bounds = F.array_sort(F.flatten(F.array(*found)))
    kept = F.filter(_slices(text, bounds, trim_next), lambda s: F.length(s["text"]) >= min_length)
    body = F.array(
        F.struct(F.lit("body").alias("section_name"), text.alias("text"), F.lit(0).alias("start_char"), F.length(text).alias("end_char"))
    )
    return F.when(text.isNull(), None).when(F.size(bounds) == 0, body).otherwise(kept)


def radiology_sections(text: Column) -> Column:
    """A report's sections by the first match of each header: array of (section_name, text, start_char, end_char)."""
    found = [F.slice(_bounds(match_spans(text, f"(?i){k}{_END}"), i, k), 1, 1) for i, k in enumerate(RADIOLOGY_HEADERS)]
    bounds = F.array_sort(F.flatten(F.array(*found)))
    return F.when(text.isNotNull(), _slices(text, bounds, False))


def radiology_impression(sections: Column) -> Column:
    """The impression, else the findings, else ''."""
    m = F.map_from_entries(F.transform(sections, lambda s: F.struct(s["section_name"], s["text"])))
    return F.coalesce(m["impression"], m["findings"], F.lit(""))


def clean_notes(notes: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Notes that are no errors, have text and, if given, one of the categories (compared without padding)."""
    d = notes.where((F.coalesce("iserror", F.lit("")) != "1") & F.col("text").isNotNull() & (F.trim("text") != ""))
    return d.where(F.trim("category").isin(categories)) if categories else d


def note_documents(notes: DataFrame, min_length: int = 20) -> DataFrame:
    """Retrieval documents of (row_id, category, chartdate, text, sections): the full note, or one per section.

    Notes whose ``sections`` are null or empty give ``note_<id>``; others give ``note_<id>_<n>_<section>`` for
    every section of at least ``min_length`` characters.
    """
    base = notes.withColumn("_id", F.concat(F.lit("note_"), F.col("row_id").cast("string")))
    whole = base.where(F.coalesce(F.size("sections"), F.lit(-1)) <= 0).select(
        F.col("_id").alias("doc_id"), "row_id", F.lit("full_note").alias("section"), note_type(F.trim("category")).alias("note_type"), "text"
    )
    parts = base.select("*", F.posexplode("sections").alias("_n", "_s")).where(F.length("_s.text") >= min_length)
    return whole.unionByName(
        parts.select(
            F.concat_ws("_", "_id", "_n", "_s.section_name").alias("doc_id"), "row_id", F.col("_s.section_name").alias("section"),
            note_type(F.trim("category")).alias("note_type"), F.col("_s.text").alias("text"),
        )
    )
