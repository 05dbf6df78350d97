"""Text functions on columns: tokens, sentences, white space, matches with offsets. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that sparse retrieval leaves out; they have to be these for equal scores.
CLINICAL_STOPWORDS = (
    "patient", "patients", "history", "diagnosis", "treatment", "clinical", "medical", "hospital", "care", "health", "disease", "condition",
    "symptoms", "reported", "noted", "presented", "was", "were", "the", "and", "of", "in", "to", "a", "an", "is", "are", "for", "with",
    "that", "this", "has", "have", "had", "been", "not", "no",
)

# Abbreviations after which no sentence ends; they have to be these for equal sentences.
ABBREVIATIONS = (
    "q.d.", "q.i.d.", "t.i.d.", "b.i.d.", "p.r.n.", "p.o.", "s.l.", "i.v.", "i.m.", "s.c.", "i.t.", "i.a.", "i.p.",
    "dr.", "mr.", "mrs.", "ms.", "prof.", "jr.", "sr.", "fig.", "et al.", "e.g.", "i.e.", "cf.", "vs.",
    "resp.", "temp.", "approx.", "incl.", "excl.", "max.", "min.", "dept.", "div.", "no.", "vol.", "pt.", "pts.", "wt.", "ht.",
    "mg.", "ml.", "dl.", "kg.", "cm.", "mm.", "hr.",
)


def _quoted(s: str) -> str:
    return s.replace(".", r"\.")


def word_count(text: Column) -> Column:
    """Number of words separated by white space; null for null."""
    return F.regexp_count(text, F.lit(r"\S+"))


def token_estimate(text: Column) -> Column:
    """Floor of 1.3 times the words."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def clean_whitespace(text: Column) -> Column:
    """Three or more line breaks become two, then line ends lose trailing blanks, then the text its outer ones."""
    t = F.regexp_replace(text, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+(?=\n|\z)", "")
    return F.regexp_replace(t, r"\A\s+|\s+\z", "")


def sentences_plain(text: Column) -> Column:
    """Stretches between white space that follows ``.``, ``!`` or ``?``; empty ones are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


#: Upper and lower case of an abbreviation are told apart no more once it is protected.
_PROTECTED = "(?i)" + "|".join(_quoted(a) for a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)))
_BREAK = (
    r"(?<=[.!?])(?<!" + "|".join(_quoted(a) for a in ABBREVIATIONS) + r")\s+(?=[A-Z0-9]|(?:" + "|".join(_quoted(a) for a in ABBREVIATIONS) + "))"
)


def sentences_biomedical(text: Column) -> Column:
    """Sentences that end at ``.``, ``!`` or ``?`` before a capital, a digit or an abbreviation, but not after an abbreviation.

    Abbreviations count wherever their letters stand, also at the end of a word ("symptoms."), and come
    out in lower case.
    """
    low = text
    for a in ABBREVIATIONS:
        low = F.regexp_replace(low, "(?i)" + _quoted(a), a)
    return F.filter(F.transform(F.split(low, _BREAK), lambda s: F.trim(s)), lambda s: s != "")


def bm25_tokens(text: Column) -> Column:
    """Lower-cased words of 2 to 31 letters, digits or hyphens that begin with a letter, without stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z][a-z0-9\-]{1,30}\b"), F.lit(0)), lambda w: ~w.isin(*CLINICAL_STOPWORDS))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0)))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by spaces; empty when there are fewer."""
    return F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


_OPEN, _CLOSE = "\u0001", "\u0002"


def match_spans(text: Column, pattern: str) -> Column:
    """Non-overlapping matches of a pattern as array of (start, end), half-open, in characters.

    The text is marked around each match and cut at the marks; lengths are added up. The two mark
    characters must not occur in the text.
    """
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}")
    parts = F.slice(F.split(marked, _OPEN), 2, 1_000_000)
    head = F.length(F.element_at(F.split(marked, _OPEN), 1))
    start = F.struct(head.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, p):
        inner = F.length(F.substring_index(p, _CLOSE, 1))
        span = F.struct(acc["at"].alias("start"), (acc["at"] + inner).alias("end"))
        return F.struct((acc["at"] + F.length(p) - 1).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(parts, start, step, lambda acc: acc["out"]))
