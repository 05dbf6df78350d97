"""File sources and sinks: note tables, document lines, benchmark formats, manifests, reports, settings."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_COLUMNS = (
    "ROW_ID bigint, SUBJECT_ID bigint, HADM_ID bigint, CHARTDATE string, CHARTTIME string, STORETIME string, CATEGORY string, DESCRIPTION string, "
    "CGID int, ISERROR string, TEXT string"
)


def read_notes_csv(spark: SparkSession, path: str) -> DataFrame:
    """A note export in CSV with quoted multi-line texts; columns in lower case."""
    d = spark.read.csv(path, schema=NOTE_COLUMNS, header=True, multiLine=True, quote='"', escape='"')
    return d.toDF(*[c.lower() for c in d.columns])


def note_counters(notes: DataFrame) -> DataFrame:
    """One row: total, errors, empty, kept."""
    error = F.coalesce("iserror", F.lit("")) == "1"
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    return notes.agg(
        F.count("*").alias("total"), F.count_if(error).alias("errors"), F.count_if(~error & empty).alias("empty"), F.count_if(~error & ~empty).alias("kept")
    )


def read_documents(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """JSON lines below ``path`` in document form (id, text, metadata) or chunk form (chunk_id, ...): (doc_id, text, metadata map)."""
    schema = "id string, chunk_id string, text string, metadata map<string,string>"
    d = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path)
    d = d.select(F.coalesce("chunk_id", "id").alias("doc_id"), "text", "metadata").where("doc_id is not null")
    return d.limit(most) if most else d


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines: id, text and all other columns as metadata."""
    meta = [c for c in docs.columns if c not in ("doc_id", "text")]
    cols = [F.col("doc_id").cast("string").alias("id"), "text"] + ([F.struct(*meta).alias("metadata")] if meta else [])
    docs.select(*cols).write.mode("overwrite").json(path)


def text_list(c: Column) -> Column:
    """A JSON value that is a string or a list of strings, as a list."""
    return F.when(c.isNull(), None).when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question sets in JSON lines: question, answer, relevant_doc_ids."""
    return spark.read.schema("question string, answer string, relevant_doc_ids array<string>").json(path)


def read_bioasq(spark: SparkSession, path: str) -> DataFrame:
    """A BioASQ file: id, type, body, exact and ideal answers as lists, documents."""
    q = "struct<id:string,type:string,body:string,ideal_answer:string,exact_answer:string,documents:array<string>>"
    d = spark.read.schema(f"questions array<{q}>").option("multiLine", "true").json(path)
    e = d.select(F.explode("questions").alias("q")).select("q.*")
    return e.select("id", "type", "body", text_list(F.col("exact_answer")).alias("exact"), text_list(F.col("ideal_answer")).alias("ideal"), "documents")


def read_pubmedqa(spark: SparkSession, path: str) -> DataFrame:
    """A PubMedQA file, one object keyed by pmid: pmid, question, contexts, label (``maybe`` without a decision)."""
    v = "struct<QUESTION:string,CONTEXTS:array<string>,LABELS:array<string>,LONG_ANSWER:string,final_decision:string>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{v}>")).alias("pmid", "v"))
    return d.select("pmid", F.col("v.QUESTION").alias("question"), F.col("v.CONTEXTS").alias("contexts"), F.coalesce("v.final_decision", F.lit("maybe")).alias("label"))


def read_medqa(spark: SparkSession, path: str) -> DataFrame:
    """MedQA lines: question, options, gold (the index letter, else the answer)."""
    d = spark.read.schema("question string, options map<string,string>, answer_idx string, answer string").json(path)
    return d.select("question", "options", F.coalesce("answer_idx", "answer").alias("gold"))


def parse_con(lines: DataFrame, value: str = "value") -> DataFrame:
    """Entities of annotation lines ``c="text" l:w l:w||t="type"``: (text, type); other lines are left out."""
    rx = r'^\s*c="([^"]+)"\s+[\d:]+\s+[\d:]+\|\|t="(\w+)"'
    keep = [c for c in lines.columns if c != value]
    d = lines.where(F.col(value).rlike(rx))
    return d.select(*keep, F.regexp_extract(value, rx, 1).alias("text"), F.regexp_extract(value, rx, 2).alias("type"))


def read_i2b2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts, gold) of a folder of ``x.txt`` and ``x.con``: (doc_id, text) that have annotations, and (doc_id, text, type)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    con = parse_con(spark.read.text(path, pathGlobFilter="*.con").select(name.alias("doc_id"), "value"))
    txt = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(name.alias("doc_id"), F.col("value").alias("text"))
    have = spark.read.format("binaryFile").option("pathGlobFilter", "*.con").load(path).select(F.regexp_extract("path", r"([^/]+)\.con$", 1).alias("doc_id"))
    return txt.join(have, "doc_id", "left_semi"), con


# Tags of the entity benchmark by number.
NER_TAGS = ("O", *(f"{p}-{t}" for t in ("DISEASE", "DRUG", "GENE", "PROTEIN", "MUTATION", "CELL_LINE", "SPECIES", "ANATOMY") for p in "BI"))


def read_ner(spark: SparkSession, path: str) -> DataFrame:
    """Tagged sentences in JSON lines as (doc_id, pos, token, tag); doc_id counts lines by file and place."""
    d = spark.read.schema("tokens array<string>, ner_tags array<int>").json(path).withColumn("doc_id", F.monotonically_increasing_id())
    names = F.array(*[F.lit(t) for t in NER_TAGS])
    e = d.select("doc_id", F.posexplode(F.arrays_zip("tokens", "ner_tags")).alias("pos", "x"))
    return e.select("doc_id", "pos", F.col("x.tokens").alias("token"), F.coalesce(F.get(names, F.col("x.ner_tags")), F.lit("O")).alias("tag"))


def write_manifest(spark: SparkSession, path: str, **values) -> None:
    """Index manifest: one JSON object with the given values and the time."""
    body = {"version": "1", "created_at": datetime.now(UTC).isoformat(timespec="seconds"), **values}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines in one file; reports are a few rows by nature."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_settings(path: str) -> dict:
    """Settings of a YAML file, where that library is installed, else of a JSON file."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


