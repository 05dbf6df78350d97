"""Console entry: ingest, index, query, review and evaluate from files."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corpuslane.plans import pipeline
from corpuslane.session import build_session
from corpuslane.sources import files, pubmed


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuslane")
    p.add_argument("--master")
    p.add_argument("--config", help="settings file (JSON)")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("ingest", help="articles (XML) or notes (CSV) to chunks")
    x.add_argument("--input", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--kind", choices=("articles", "notes"), default="articles")
    x = sub.add_parser("build-index", help="chunks to an index")
    x.add_argument("--input", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--index-type", choices=("flat", "ivf"))
    for name in ("query", "review"):
        x = sub.add_parser(name, help="answers from an index")
        x.add_argument("--index", required=True)
        x.add_argument("--top-k", type=int)
        x.add_argument("question", nargs="+")
    x = sub.add_parser("evaluate", help="means over a question set (JSON lines: question, answer, relevant_doc_ids)")
    x.add_argument("--index", required=True)
    x.add_argument("--qa-dataset", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--retrieval-only", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = build_session("corpuslane", a.master)
    nested = files.read_settings(a.config) if a.config else {}
    s = pipeline.Settings.of(nested | ({"top_k": a.top_k} if getattr(a, "top_k", None) else {}) | ({"index_type": a.index_type} if getattr(a, "index_type", None) else {}))
    if a.command == "ingest":
        chunks = pipeline.ingest_articles(pubmed.read_xml(spark, a.input), s) if a.kind == "articles" else pipeline.ingest_notes(files.read_notes_csv(spark, a.input), s)
        chunks.write.mode("overwrite").parquet(a.output)
    elif a.command == "build-index":
        pipeline.build_index(spark.read.parquet(a.input), a.output, s)
    elif a.command == "evaluate":
        qa = files.read_qa(spark, a.qa_dataset)
        qa = qa if "query_id" in qa.columns else qa.withColumn("query_id", F.xxhash64("question"))
        pipeline.report(pipeline.load_index(spark, a.index), qa, s, generate=not a.retrieval_only).coalesce(1).write.mode("overwrite").json(a.output)
    else:
        q = spark.createDataFrame([(k, t) for k, t in enumerate(a.question)], "query_id bigint, text string")
        r = pipeline.load_index(spark, a.index)
        out = pipeline.answer(r, q, s) if a.command == "query" else pipeline.literature_review(r, q, s=s)
        for row in out.orderBy("query_id").toLocalIterator():
            print(row["answer"], end="\n\n")


if __name__ == "__main__":
    main()
