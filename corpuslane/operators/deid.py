"""Removal of health identifiers by an ordered cascade of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CAP = "[A-Z][a-z]+"

# Identifier patterns, in the order in which they apply. Case is ignored.
PHI_PATTERNS: dict[str, str] = {
    "name_with_title": rf"\b(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Prof\.?)\s+{_CAP}(?:\s+{_CAP})*",
    "name_placeholder": r"\[\*\*[^\]]*(?:Name|name)[^\]]*\*\*\]",
    "street_address": rf"\d{{1,5}}\s+{_CAP}(?:\s+{_CAP})*\s+(?:St\.?|Ave\.?|Blvd\.?|Dr\.?|Rd\.?|Lane|Way|Court|Ct\.?)",
    "zip_code": r"\b\d{5}(?:-\d{4})?\b",
    "city_state": rf"\b{_CAP}(?:\s{_CAP})?,\s*[A-Z]{{2}}\b",
    "full_date": r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b",
    "month_day": r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}(?:,\s*\d{4})?\b",
    "mimic_date_placeholder": r"\[\*\*\d{4}-\d{1,2}(?:-\d{1,2})?\*\*\]",
    "phone": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "mrn": r"\b(?:MRN|Medical Record(?: Number)?|Patient ID|Pt ID)\s*[:#]?\s*\d+\b",
    "mimic_number_placeholder": r"\[\*\*\d+\*\*\]",
    "account_number": r"\b(?:Account|Acct|Policy|Member ID)\s*[:#]?\s*[\p{L}\p{N}_-]+\b",
    "url": r"https?://\S+",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "mimic_phi_placeholder": r"\[\*\*[^\]]*\*\*\]",
}

TOKEN = "[REDACTED]"


def deidentify(df: DataFrame, text: str, out: str = "deidentified", count: str = "phi_count", token: str = TOKEN) -> DataFrame:
    """``df`` with the redacted text and the number of replacements.

    Each pattern counts and replaces in what the ones before it left. Null gives null and 0. One chain
    of projections; nothing leaves the JVM.
    """
    d = df.withColumn("_t", F.col(f"`{text}`")).withColumn("_n", F.lit(0))
    for p in PHI_PATTERNS.values():
        rx = "(?i)" + p
        # each text refers to the one before it once: filters above may be pushed down through the whole chain
        d = d.withColumn("_n", F.col("_n") + F.coalesce(F.regexp_count("_t", F.lit(rx)), F.lit(0))).withColumn("_t", F.regexp_replace("_t", rx, token))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (out, count)]
    return d.select(*keep, F.col("_t").alias(out), F.col("_n").alias(count))


def contains_phi(text: Column) -> Column:
    """Whether any pattern matches; null for null."""
    c = F.lit(False)
    for p in PHI_PATTERNS.values():
        c = c | text.rlike("(?i)" + p)
    return c


def audit(df: DataFrame, text: str) -> DataFrame:
    """(phi_type, n, texts): matches per pattern on the original texts, and the texts that have one."""
    counts = [F.struct(F.lit(k).alias("phi_type"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("(?i)" + p)), F.lit(0)).alias("n")) for k, p in PHI_PATTERNS.items()]
    e = df.select(F.explode(F.array(*counts)).alias("x")).select("x.*")
    return e.groupBy("phi_type").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("texts"))
