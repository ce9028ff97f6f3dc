"""Texts of chunks: context prefix, content, labelled bodies, previews, notes of withdrawal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what goes before a query, and never before a document, when it is embedded.
QUERY_INSTRUCTION = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:"


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def context_prefix(framework: Column, version: Column, ancestors: Column, title: Column) -> Column:
    """`framework version > ancestor > ... > title`; an empty title is left out."""
    head = F.concat_ws(" ", framework, version)
    return F.concat_ws(" > ", F.concat(F.array(head), F.coalesce(ancestors, F.array().cast("array<string>"))), _some(title))


def chunk_content(citation: Column, title: Column, body: Column, eq_framework: Column, eq_citation: Column, eq_body: Column) -> Column:
    """Citation, title and body, then an equivalent control's body under a label that names where it comes from."""
    own = F.concat(citation, F.coalesce(F.concat(F.lit(" "), _some(title)), F.lit("")), F.coalesce(F.concat(F.lit("\n"), _some(body)), F.lit("")))
    borrowed = F.concat(F.lit("\n\n[equivalent "), eq_framework, F.lit(" "), eq_citation, F.lit("]\n"), _some(eq_body))
    return F.concat(own, F.coalesce(borrowed, F.lit("")))


def embedding_text(prefix: Column, content: Column) -> Column:
    return F.concat_ws("\n", _some(prefix), content)


def embedding_query(query: Column) -> Column:
    return F.concat(F.lit(QUERY_INSTRUCTION), query)


def same_model(a: Column, b: Column) -> Column:
    """Whether two model names agree but for case and organisation."""
    return F.lower(F.substring_index(a, "/", -1)) == F.lower(F.substring_index(b, "/", -1))


def labelled_body(description: Column, fields: list[tuple[str, Column]]) -> Column:
    """The description, an empty line, then `label: value` for each field that has a value; True reads Yes."""
    lines = [F.concat(F.lit(f"{label}: "), F.when(value == "True", "Yes").otherwise(_some(value))) for label, value in fields]
    return F.concat_ws("\n\n", _some(description), _some(F.concat_ws("\n", *lines)))


def preview(text: Column, length: int) -> Column:
    """At most so many characters, with an ellipsis where some are missing."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def withdrawal_action(note: Column) -> Column:
    """incorporated-into or moved-to; null for a note that says neither."""
    return F.when(note.rlike(r"(?i)incorporated\s+into"), "incorporated-into").when(note.rlike(r"(?i)moved\s+(?:in)?to"), "moved-to")


def withdrawal_targets(note: Column) -> Column:
    """The ids a note of withdrawal names; free text gives none."""
    listed = F.regexp_extract(note, r"(?i)(?:incorporated\s+into|moved\s+(?:in)?to)\s+([^\]]*)", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Z]{2}\.[A-Z]{2}(?:-\d{2})?$"))
