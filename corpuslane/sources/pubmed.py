"""Articles: the XML source, a paged data source for a literature service, documents, selection and de-duplication."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ARTICLE = (
    "pmid string, title string, abstract string, authors array<string>, mesh_terms array<string>, journal string, pub_date string, doi string, "
    "pmc_id string, keywords array<string>, publication_types array<string>, source string, retrieved_at string"
)


def _first(xml: Column, path: str) -> Column:
    """Text of the first element before any child, trimmed; null if empty."""
    return F.nullif(F.trim(F.get(F.xpath(xml, F.lit(f"{path}/text()[1]")), 0)), F.lit(""))


def parse_articles(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Articles of a column with one ``PubmedArticle`` element per row.

    Rows without a PMID, and null rows, give no article. Abstract parts carry their label and are joined by
    blanks; MeSH entries are the descriptor, or one ``descriptor/qualifier`` per qualifier; dates are
    Year-Month-Day with 01 for what is missing, '' without a year.
    """
    x = F.col(column)

    def all_of(path: str) -> Column:
        return F.filter(F.transform(F.xpath(x, F.lit(path + "/text()")), lambda s: F.trim(s)), lambda s: s != "")

    # repeated elements are cut out as strings first, so that each part's own children stay together
    def parts(tag: str) -> Column:
        return F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))

    def plain(s: Column) -> Column:
        t = F.regexp_replace(s, "(?s)<[^>]*>", "")
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.trim(t)

    def inner(s: Column, tag: str) -> Column:
        return plain(F.regexp_extract(s, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))

    def labelled(s: Column) -> Column:
        label = F.regexp_extract(s, r'<AbstractText[^>]*\sLabel="([^"]*)"', 1)
        return F.when(label != "", F.concat(label, F.lit(": "), plain(s))).otherwise(plain(s))

    def person(s: Column) -> Column:
        last, fore = inner(s, "LastName"), inner(s, "ForeName")
        return F.when(last == "", None).otherwise(F.when(fore != "", F.concat(last, F.lit(", "), fore)).otherwise(last))

    def heading(s: Column) -> Column:
        d = inner(s, "DescriptorName")
        q = F.transform(F.regexp_extract_all(s, F.lit(r"(?s)<QualifierName[^>]*>.*?</QualifierName>"), F.lit(0)), plain)
        return F.when(d == "", F.array().cast("array<string>")).when(F.size(q) > 0, F.transform(q, lambda y: F.concat(d, F.lit("/"), y))).otherwise(F.array(d))

    def text_or(path: str, other: str) -> Column:
        return F.coalesce(_first(x, path), F.lit(other))

    year = _first(x, "//Article/Journal//PubDate/Year")
    date = F.when(year.isNull(), "").otherwise(F.concat_ws("-", year, text_or("//Article/Journal//PubDate/Month", "01"), text_or("//Article/Journal//PubDate/Day", "01")))
    return (
        xml.where(x.isNotNull())
        .select(
            _first(x, "//MedlineCitation/PMID").alias("pmid"),
            text_or("//ArticleTitle", "").alias("title"),
            F.array_join(F.transform(parts("AbstractText"), labelled), " ").alias("abstract"),
            F.filter(F.transform(parts("Author"), person), lambda a: a.isNotNull()).alias("authors"),
            F.flatten(F.transform(parts("MeshHeading"), heading)).alias("mesh_terms"),
            text_or("//Article/Journal/Title", "").alias("journal"),
            date.alias("pub_date"),
            _first(x, "//ArticleId[@IdType='doi']").alias("doi"),
            _first(x, "//ArticleId[@IdType='pmc']").alias("pmc_id"),
            all_of("//Keyword").alias("keywords"),
            all_of("//PublicationType").alias("publication_types"),
            F.lit("pubmed").alias("source"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("retrieved_at"),
        )
        .where("pmid is not null")
    )


def split_set(text: Column) -> Column:
    """The ``PubmedArticle`` elements of a response."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<PubmedArticle(?:\s[^>]*)?>.*?</PubmedArticle>"), F.lit(0))


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files, one task per file at least; broken articles are left out."""
    files = spark.read.text(path, wholetext=True)
    return parse_articles(files.select(F.explode(split_set(F.col("value"))).alias("xml")))


def to_documents(articles: DataFrame) -> DataFrame:
    """Retrieval documents: doc_id ``pmid_<pmid>``, text of title and abstract, metadata as columns, ``pub_year``."""
    text = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\nAbstract: "), F.coalesce("abstract", F.lit("")))
    meta = ("pmid", "title", "journal", "pub_date", "authors", "mesh_terms", "keywords", "publication_types", "doi", "source")
    return articles.where("pmid is not null").select(F.concat(F.lit("pmid_"), "pmid").alias("doc_id"), text.alias("text"), *meta, pub_year(F.col("pub_date")).alias("pub_year"))


def pub_year(date: Column) -> Column:
    """The first four characters of a date as a number; null if they are none."""
    return F.when(F.substring(date, 1, 4).rlike(r"^\d{4}$"), F.substring(date, 1, 4).cast("int"))


def mesh_query(term: str, first: int | None = None, last: int | None = None) -> str:
    """A search expression of the service for a MeSH term and a span of years."""
    q = f'"{term}"[MeSH Terms]'
    return f"{q} AND {first}:{last}[PDAT]" if first and last else q


def by_mesh(articles: DataFrame, term: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The same selection on a table: articles with the descriptor (case ignored, qualifiers aside) in the span of years."""
    has = F.exists("mesh_terms", lambda m: F.lower(F.trim(F.split_part(m, F.lit("/"), F.lit(1)))) == term.lower())
    d = articles.where(has)
    y = pub_year(F.col("pub_date"))
    return d.where(y.between(first, last)) if first and last else d


# Descriptors by clinical domain.
CLINICAL_DOMAINS = {
    "cardiology": ("Atrial Fibrillation", "Heart Failure", "Myocardial Infarction", "Coronary Artery Disease", "Hypertension"),
    "oncology": ("Breast Neoplasms", "Lung Neoplasms", "Colorectal Neoplasms", "Leukemia", "Lymphoma"),
    "neurology": ("Alzheimer Disease", "Parkinson Disease", "Stroke", "Epilepsy", "Multiple Sclerosis"),
    "pharmacology": ("Adverse Drug Reaction Reporting Systems", "Drug Interactions", "Drug Toxicity", "Pharmacokinetics"),
    "ai_clinical": ("Artificial Intelligence", "Machine Learning", "Natural Language Processing", "Clinical Decision Support Systems", "Electronic Health Records"),
}


def by_domain(articles: DataFrame, domain: str, order: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Articles with a descriptor of a domain, each pmid once with the number of the first descriptor that fits as ``part``."""
    return first_wins([by_mesh(articles, t, first, last) for t in CLINICAL_DOMAINS[domain]], "pmid", order)


def first_wins(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of several selections in which each ``key`` keeps the row of the first selection, there of the least ``order``.

    The minimum is taken with map-side combine; rows of a key that repeats do not gather for a sort.
    """
    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("_part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    cols = [c for c in out.columns if c not in ("_part", key)]
    g = out.groupBy(key).agg(F.min_by(F.struct(*cols, "_part"), F.struct("_part", order)).alias("x"))
    return g.select(key, *[F.col(f"x.{c}") for c in cols], F.col("x._part").alias("part"))


def with_retry(call: Callable, times: int = 3, backoff: float = 2.0, errors: tuple = (OSError,)):
    """``call`` tried again after errors, waiting ``backoff`` to the power of the attempt in seconds."""

    def run(*a, **k):
        for attempt in range(times):
            try:
                return call(*a, **k)
            except errors:
                if attempt == times - 1:
                    raise
                time.sleep(backoff**attempt)

    return run


class _Page(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict, search: Callable, fetch: Callable):
        self.query, self.size = options.get("query", ""), int(options.get("batch_size", "200"))
        self.most, self.pause = int(options.get("max_results", "10000")), float(options.get("pause", "0.34"))
        self.search, self.fetch = search, fetch

    def partitions(self) -> list[InputPartition]:
        total = min(with_retry(self.search)(self.query), self.most)
        return [_Page(s, min(self.size, total - s)) for s in range(0, total, self.size)] or [_Page(0, 0)]

    def read(self, part: _Page) -> Iterator[tuple]:
        if part.size:
            time.sleep(self.pause)
            yield (part.start, with_retry(self.fetch)(self.query, part.start, part.size))


def paged_source(search: Callable[[str], int], fetch: Callable[[str, int, int], str]) -> type[DataSource]:
    """A data source class ``literature`` over two calls: the number of hits of a query, and the XML of a page.

    Register it by ``spark.dataSource.register`` and read (start, xml) with options query, batch_size,
    max_results and pause. One partition per page; failed calls are tried again with growing waits.
    """

    class Literature(DataSource):
        @classmethod
        def name(cls) -> str:
            return "literature"

        def schema(self) -> str:
            return "start bigint, xml string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), search, fetch)

    return Literature


def fresh(cache: DataFrame, hours: int = 72) -> DataFrame:
    """Rows of a response cache (key, body, fetched_at) that are not expired."""
    return cache.where(F.col("fetched_at") > F.current_timestamp() - F.expr(f"INTERVAL {hours} HOURS"))


_CACHED = "key string, body string, fetched_at timestamp"


def fetch_by_ids(ids: DataFrame, path: str, fetch: Callable[[list[str]], str], hours: int = 72, batch_size: int = 200, pause: float = 0.34) -> DataFrame:
    """(pmid, xml) of a table of ids (pmid), from a response cache at ``path`` first.

    Ids that the cache lacks, or whose entry is older than ``hours``, are fetched in batches (with growing
    waits after errors) and appended to the cache, one entry per article, before the result is read from
    it. Null and repeated ids count once; an id that the service does not know gives no row.
    """
    spark = ids.sparkSession
    want = ids.where("pmid is not null").select(F.col("pmid").alias("key")).distinct()
    try:
        cache = fresh(spark.read.schema(_CACHED).parquet(path), hours)
        cache.limit(1).count()
    except AnalysisException:  # there is none yet
        cache = spark.createDataFrame([], _CACHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = with_retry(fetch)
        for b in batches:
            keys = b.column(0).to_pylist()
            for k in range(0, len(keys), batch_size):
                time.sleep(pause)
                yield pa.RecordBatch.from_arrays([pa.array([get(keys[k : k + batch_size])], pa.string())], names=["body"])

    missing = want.join(cache, "key", "left_anti").repartition(max(1, spark.sparkContext.defaultParallelism))
    articles = missing.mapInArrow(run, "body string").select(F.explode(split_set(F.col("body"))).alias("body"))
    key = F.regexp_extract("body", r"<PMID[^>]*>\s*([^<\s]+)\s*</PMID>", 1)
    articles.select(key.alias("key"), "body", F.current_timestamp().alias("fetched_at")).where("key != ''").write.mode("append").parquet(path)
    newest = fresh(spark.read.schema(_CACHED).parquet(path), hours).groupBy("key").agg(F.max_by("body", "fetched_at").alias("xml"))
    return newest.join(want, "key").select(F.col("key").alias("pmid"), "xml")
