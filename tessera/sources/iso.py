"""Control trees of the ISO/IEC 27000 family from the text of their pages.

A capture is (doc_key, page, text). One publication is read in streams: pages that belong together, with headings of
their own. A line automaton runs over each stream's lines: a line that fits a heading opens its section at its first
sighting, all others but furniture belong to the section that is open. The sections of all streams are one tree, in the
order of their groups, then of lines or of citations; a parent counts if it stands above. Every step is a window over one
document's lines, so any number of documents is one job.

Trees are (doc_key, ordinal, citation, citation_norm, kind, status, title, body, parent).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.citations import dotted_order, dotted_parent


@dataclass(frozen=True)
class Heading:
    """A pattern whose first group is the number, the main numbers it may begin with, and what a section of it is.

    shadow: a pattern of lines that are no heading even if this one would fit. inline: the body is the rest of the line;
    bodies: there is one at all. group: its place in the tree.
    """

    pattern: str
    kind: str
    label: str
    mains: range | None = None
    prefix: str = ""
    group: int = 0
    shadow: str = r"(?!)"
    inline: bool = False
    bodies: bool = True


@dataclass(frozen=True)
class Stream:
    """Which pages of a document, what furniture they have, and their headings, of which the first that fits counts."""

    headings: tuple[Heading, ...]
    pages: str = "all"
    skip: str = ""
    by_citation: bool = False
    strip: bool = False


#: Furniture, and how numbers and headings are written.
_FURNITURE = r"All rights reserved|^\d+$|^ISO/IEC"
_CONTENTS = rf"{_FURNITURE}|\.\.\."
_ONE, _SUB = r"^(\d+)\s+.+", r"^(\d+(?:\.\d+)+)\s+.+"
_TABLE, _FIRST_ANNEX_PAGE = "Table A.1", 11
STREAMS = {
    "iso27001": (
        Stream((Heading(_SUB, "clause", "Clause", range(4, 11)), Heading(_ONE, "clause", "Clause", range(4, 11))), "clauses", r"All rights reserved|^\d+$|^ISO/IEC 2700|^Table A\.1|\.\.\."),
        Stream((Heading(r"^(\d+\.\d+)\s+.+", "annex-control", "Annex A control", range(5, 9), "A.", 1, inline=True), Heading(_ONE, "domain", "Annex A theme", range(5, 9), "A.", 1, shadow=r"^\d+\.\d+\s+.+", bodies=False)), "annex", rf"{_FURNITURE}|^Table A\.1", by_citation=True),
    ),
    "iso27002": (Stream((Heading(r"^(\d+\.\d+)\s+.+", "control", "Control", range(5, 9), group=1), Heading(_ONE, "domain", "Theme", range(5, 9), shadow=_SUB, bodies=False)), skip=_CONTENTS, strip=True),),
    "iso27017": (Stream((Heading(r"^(CLD\.\d+\.\d+(?:\.\d+)?)\s", "control", "Control", group=1), Heading(_SUB, "control", "Control", range(5, 19)), Heading(_ONE, "control", "Control", range(5, 19), shadow=_SUB)), skip=_CONTENTS),),
    "iso27018": (Stream((Heading(r"^(A\.\d+\.\d+)\s", "annex-control", "Annex A control", group=1), Heading(_SUB, "control", "Control", range(5, 19)), Heading(_ONE, "control", "Control", range(5, 19), shadow=_SUB)), skip=_CONTENTS),),
}


def _lines(pages: DataFrame) -> DataFrame:
    """doc_key, page, no, line, annex: lines without outer space that are not blank; annex: the first page of the annex' table, if there is one."""
    each = pages.select("doc_key", "page", F.contains("text", F.lit(_TABLE)).alias("table"), F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c")))
    starts = F.when((F.col("page") >= _FIRST_ANNEX_PAGE) & F.col("line").startswith(_TABLE), F.col("page"))
    return each.withColumn("annex", F.min(starts).over(Window.partitionBy("doc_key"))).filter("line <> ''")


def _of(pages: str) -> Column:
    if pages == "clauses":
        return F.col("annex").isNull() | (F.col("page") < F.col("annex"))
    if pages == "annex":
        return F.col("table") & (F.col("page") >= _FIRST_ANNEX_PAGE)
    return F.lit(True)


def _opened(line: Column, h: Heading) -> Column:
    number = F.regexp_extract(line, h.pattern, 1)
    main = F.split(number, r"\.")[0].try_cast("int")
    fits = (number != "") & ~line.rlike(h.shadow)
    return fits if h.mains is None else fits & F.coalesce(main.between(h.mains.start, h.mains.stop - 1), F.lit(False))


def _sections(lines: DataFrame, stream: Stream, k: int) -> DataFrame:
    """doc_key, stream, page, no (of the heading), which (heading of the stream), citation, body."""
    line = F.col("line")
    which, citation = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, h in reversed(list(enumerate(stream.headings))):
        fits = _opened(line, h)
        which = F.when(fits, n).otherwise(which)
        citation = F.when(fits, F.concat(F.lit(h.prefix), F.regexp_extract(line, h.pattern, 1))).otherwise(citation)
    held = lines.filter(_of(stream.pages) & ~line.rlike(stream.skip)).withColumns({"which": which, "citation": citation})
    first = F.row_number().over(Window.partitionBy("doc_key", "citation").orderBy("page", "no")) == 1
    held = held.withColumn("opens", F.col("citation").isNotNull() & first)
    section = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc_key").orderBy("page", "no").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("section", section).filter("section > 0")
    at = F.struct("page", "no", "line")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), at))), lambda x: x["line"]), "\n")
    own = F.max(F.when(F.col("opens"), F.struct("page", "no", "which", "citation", "line")))
    out = held.groupBy("doc_key", "section").agg(own.alias("h"), told.alias("told")).select("doc_key", F.lit(k).alias("stream"), "h.*", "told")
    body = F.lit(None).cast("string")
    for n, h in enumerate(stream.headings):
        rest = F.btrim(F.substring("line", F.length(F.regexp_extract("line", h.pattern, 1)) + 1, 1 << 30), F.lit(" \t"))
        body = F.when((F.col("which") == n) & F.lit(h.bodies), rest if h.inline else F.col("told")).otherwise(body)
    return out.withColumn("body", strip_attributes(body) if stream.strip else body).drop("line", "told")


def iso_tree(pages: DataFrame, framework: str) -> DataFrame:
    """The trees of all documents of one publication, a key of STREAMS."""
    streams = STREAMS[framework]
    lines = _lines(pages)
    found = functools.reduce(DataFrame.unionByName, [_sections(lines, s, k) for k, s in enumerate(streams)])
    is_ = lambda k, n: (F.col("stream") == k) & (F.col("which") == n)
    pick = lambda of: F.coalesce(*[F.when(is_(k, n), F.lit(of(h))) for k, s in enumerate(streams) for n, h in enumerate(s.headings)])
    by_citation = functools.reduce(Column.__or__, [(F.col("stream") == k) & F.lit(s.by_citation) for k, s in enumerate(streams)])
    held = found.withColumns({"group": pick(lambda h: h.group), "kind": pick(lambda h: h.kind), "label": pick(lambda h: h.label), "sort": F.when(by_citation, dotted_order(F.col("citation")))})
    order = Window.partitionBy("doc_key").orderBy("group", F.col("sort").asc_nulls_first(), "page", "no")
    held = held.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    above = held.select(F.col("doc_key").alias("__k"), F.col("citation").alias("__p"), F.col("ordinal").alias("__o"))
    tree = held.withColumn("__w", dotted_parent(F.col("citation"))).join(above, (F.col("doc_key") == F.col("__k")) & (F.col("__w") == F.col("__p")) & (F.col("__o") < F.col("ordinal")), "left")
    return tree.select("doc_key", "ordinal", "citation", F.upper("citation").alias("citation_norm"), "kind", F.lit("active").alias("status"), F.concat_ws(" ", "label", "citation").alias("title"), F.when(F.col("body") != "", F.col("body")).alias("body"), F.upper("__p").alias("parent"))


#: Fixed value: within so many lines the attributes of a body end, after those before.
_ATTRIBUTES = 21


def strip_attributes(body: Column) -> Column:
    """A body without its attribute table, which ends with the first line `Control` below a line of `#tags`, both near its start; as it is where there is none."""

    def stripped(lines: Column) -> Column:
        trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r")))
        near = F.slice(trimmed, 1, _ATTRIBUTES)
        tag = F.get(F.filter(F.transform(near, lambda x, i: F.when(x.startswith("#"), i)), lambda i: i.isNotNull()), F.lit(0))
        ends = F.filter(F.transform(near, lambda x, i: F.when((x == "Control") & (i > tag), i)), lambda i: i.isNotNull())
        rest = F.array_join(F.slice(lines, F.get(ends, F.lit(0)) + 2, F.size(lines)), "\n")
        return F.when(F.size(ends) > 0, F.btrim(rest, F.lit(" \t\r\n"))).otherwise(F.array_join(lines, "\n"))

    return F.when(body.isNotNull(), F.get(F.transform(F.array(F.split(body, "\n")), stripped), F.lit(0)))
