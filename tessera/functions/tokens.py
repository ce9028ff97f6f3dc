"""Tokens of control text, their dimensions, and what a query keeps of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of token characters, words of a run, dimensions, and words that a query drops.
RUN = r"[\p{L}\p{Nd}.()&-]+"
WORD = r"[\p{L}\p{Nd}]+"
DIMENSIONS = 1 << 20
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
STOPWORDS = ("what", "how", "which", "does", "the", "for", "and", "are", "is", "of", "that", "a", "to", "in", "an", "control", "requirement", "cover", "address")


#: At the start of a run that has a letter with a digit or a dot, or a digit with a dot, the run up to its last character
#: that is no dot; elsewhere a word. Each lookahead stops at what it looks for, so that a run is passed a few times only.
_WITHIN = r"[\p{L}\p{Nd}.()&-]"
_LETTER_AND = r"(?=[\p{Nd}.()&-]*\p{L})(?=[\p{L}()&-]*[\p{Nd}.])"
_DIGIT_AND_DOT = r"(?=[\p{L}.()&-]*\p{Nd})(?=[\p{L}\p{Nd}()&-]*\.)"
TOKEN = rf"(?<!{_WITHIN})(?:{_LETTER_AND}|{_DIGIT_AND_DOT}){_WITHIN}*[\p{{L}}\p{{Nd}}()&-]|{WORD}"


def is_citation_token(run: Column) -> Column:
    """A letter with a digit or a dot, or a digit with a dot: such a run is kept whole."""
    return (run.rlike(r"\p{L}") & run.rlike(r"[\p{Nd}.]")) | (run.rlike(r"\p{Nd}") & run.contains("."))


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, in one pass. Citation-like runs lose dots at their end only; others fall into words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def query_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct tokens of a query without stopwords; documents keep theirs."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, stopwords)))


def dimension(term: Column) -> Column:
    """Dimension of a term, 1 to DIMENSIONS, by its 32-bit FNV-1a hash."""
    octets = F.transform(F.regexp_extract_all(F.hex(F.encode(term, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    mixed = F.aggregate(octets, F.lit(FNV_BASIS).cast("long"), lambda h, o: (h.bitwiseXOR(o) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return (mixed % DIMENSIONS + 1).cast("int")


def sparse_literal(vector: Column) -> Column:
    """A map of dimensions to weights as text, `{1:0.5,9:2.0}/1048576`, in order of the dimensions."""
    entries = F.transform(F.array_sort(F.map_entries(vector)), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit(f"}}/{DIMENSIONS}"))
