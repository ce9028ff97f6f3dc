"""Control trees from the text of pages: lines, headings, sections.

A capture is (doc_key, page, text), one row per page. All schemes work alike: lines in order, headings by a pattern,
the first sighting of a citation opens its section, lines up to the next heading or a stop line are its body, and the
parent follows from the citation. Each step is a window over one document's lines; any number of documents is parsed
in one job. Trees are (doc_key, ordinal, citation, citation_norm, kind, title, body, parent).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.citations import dotted_parent


@dataclass(frozen=True)
class Scheme:
    """How a publication's pages are read.

    heading: pattern whose first group is the citation. kinds: (pattern of a citation, kind), the first that fits.
    skip: lines that are neither heading nor body. stop: a line that ends a body. prefix: put before citations.
    pages: (first, last) page, open where None. roots: (citation, title) of rows that no page has. midline: where an id
    stands glued to the line before; with siblings, only one that opens no line itself, has a neighbour under the same
    parent that does, and is not in brackets.
    """

    heading: str
    kinds: tuple[tuple[str, str], ...]
    label: str = "Section"
    skip: str = r"^\d*$"
    stop: str = r"(?!)"
    drop: str = r"(?!)"
    prefix: str = ""
    pages: tuple[int | None, int | None] = (None, None)
    parent: str = "dotted"
    roots: tuple[tuple[str, str, str], ...] = ()
    midline: str = ""
    siblings: bool = False


#: How citations, breaks and furniture are written in each publication.
SCHEMES = {
    "pci-requirement": Scheme(r"^(A?\d+(?:\.\d+)+)\s", ((r"^A?\d+\.\d+$", "requirement-group"), (".", "requirement")), "Requirement", drop=r"^A?\d+(?:\.\d+)+(?:\.[a-z](?:\.\d+)?\s|\s+\(continued\))", skip=r"^(?:\d*|Defined Approach Requirements|Requirements and Testing Procedures)\s*$", stop=r"^(?:Customized Approach Objective|Applicability Notes|Testing Procedures|Purpose|Guidance)", midline=r"(?<=\S)\s(?=A?\d+\.\d+(?:\.\d+)+\s)", siblings=True),
    "tsc-criteria": Scheme(r"^((?:CC|A|C|PI|P)\d+\.\d+)\s", ((".", "criterion"),), "Criterion", drop=r"^P\d+\.0\s", parent="none", midline=r"(?<=\S)\s(?=(?:CC|A|C|PI|P)\d+\.[1-9]\d*\s)"),
    "cobit-objective": Scheme(r"^(?:(?i:(?:Governance|Management)\s+Objective:)\s+)?((?:EDM|APO|BAI|DSS|MEA)\d{2}(?:\.\d{2})?)\s", ((r"^[A-Z]{3}\d{2}$", "objective"), (".", "practice")), "Practice", skip=r"^(?:\d?|\d+\.\s.*|[a-z]\.\s.*)$", stop=r"^(?:Activities\s|Related Guidance|[B-G]\.\s+Component)", parent="cobit", roots=(("EDM", "domain", "Evaluate, Direct and Monitor"), ("APO", "domain", "Align, Plan and Organize"), ("BAI", "domain", "Build, Acquire and Implement"), ("DSS", "domain", "Deliver, Service and Support"), ("MEA", "domain", "Monitor, Evaluate and Assess"))),
}


def lines_of(pages: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_key, page, at, line: trimmed lines in order, with ids glued in mid-line put on lines of their own, furniture left out."""
    first, last = scheme.pages
    held = pages.filter((F.lit(first).isNull() | (F.col("page") >= F.lit(first))) & (F.lit(last).isNull() | (F.col("page") <= F.lit(last))))
    text = F.regexp_replace("text", scheme.midline, "\n") if scheme.midline and not scheme.siblings else F.col("text")
    each = held.select("doc_key", "page", F.posexplode(F.split(text, r"\r?\n")).alias("no", "line")).withColumn("line", F.trim("line"))
    if scheme.siblings:
        each = _split_beside_siblings(each, scheme)
    return each.filter(~F.col("line").rlike(scheme.skip)).withColumn("at", F.struct("page", "no"))


def _split_beside_siblings(lines: DataFrame, scheme: Scheme) -> DataFrame:
    """lines with the first id within a line put on a line of its own, where the document's other lines speak for it."""
    starts = lines.select("doc_key", F.regexp_extract("line", scheme.heading, 1).alias("id")).filter("id <> ''").distinct()
    families = starts.select("doc_key", dotted_parent(F.col("id")).alias("family")).filter("family is not null").distinct()
    parts = F.split("line", scheme.midline, 2)
    held = lines.withColumns({"parts": parts, "id": F.when(F.size(parts) == 2, F.regexp_extract(F.get(parts, F.lit(1)), scheme.heading, 1))}).withColumn("family", dotted_parent(F.col("id")))
    known = held.join(starts.withColumn("opens", F.lit(True)), ["doc_key", "id"], "left").join(families.withColumn("beside", F.lit(True)), ["doc_key", "family"], "left")
    before = F.get("parts", F.lit(0))
    count = lambda c: F.length(before) - F.length(F.replace(before, F.lit(c), F.lit("")))
    within = (count("(") > count(")")) | (count("[") > count("]"))
    apart = F.coalesce(F.col("beside") & F.col("opens").isNull() & ~within, F.lit(False))
    each = known.select("doc_key", "page", "no", F.posexplode(F.when(apart, F.col("parts")).otherwise(F.array("line"))).alias("part", "line"))
    return each.select("doc_key", "page", (2 * F.col("no") + F.col("part")).alias("no"), F.trim("line").alias("line"))


def page_tree(pages: DataFrame, scheme: Scheme) -> DataFrame:
    """The tree of every document. A citation's first sighting counts; later ones, and dropped lines, end the section above them."""
    lines = lines_of(pages, scheme)
    cite = F.regexp_extract("line", scheme.heading, 1)
    lines = lines.withColumn("cite", F.when(F.col("line").rlike(scheme.drop), "").otherwise(cite))
    seen = F.row_number().over(Window.partitionBy("doc_key", "cite").orderBy("at"))
    lines = lines.withColumn("opens", (F.col("cite") != "") & (seen == 1))
    breaks = F.col("opens") | (F.col("cite") != "") | F.col("line").rlike(scheme.stop) | F.col("line").rlike(scheme.drop)
    above = Window.partitionBy("doc_key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"section": F.sum(F.col("opens").cast("int")).over(above), "part": F.sum(breaks.cast("int")).over(above)})
    first = F.min(F.when(F.col("opens"), F.col("part"))).over(Window.partitionBy("doc_key", "section"))
    body = lines.withColumn("first", first).filter("section > 0 and part = first")
    # A heading may end in a title's first letter, which belongs to the text.
    after = F.expr(r"substring(line, length(regexp_extract(line, pattern, 1)) + locate(regexp_extract(line, pattern, 1), line))")
    body = body.withColumn("pattern", F.lit(scheme.heading))
    text = F.when(F.col("opens"), F.trim(after)).otherwise(F.col("line"))
    grouped = body.select("doc_key", "section", "at", "cite", "opens", text.alias("text")).groupBy("doc_key", "section").agg(F.max(F.when(F.col("opens"), F.col("cite"))).alias("cite"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("body"))
    citation = F.concat(F.lit(scheme.prefix), F.col("cite"))
    tree = grouped.select("doc_key", (F.col("section") + len(scheme.roots) - 1).cast("int").alias("ordinal"), citation.alias("citation"), F.col("body"))
    if scheme.roots:
        given = F.explode(F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("citation"), F.lit(None).cast("string").alias("body")) for k, (c, _, _) in enumerate(scheme.roots)]))
        roots = tree.select("doc_key").distinct().select("doc_key", given.alias("r")).select("doc_key", "r.*")
        tree = roots.unionByName(tree)
    kind = F.lit(scheme.kinds[-1][1])
    for pattern, name in reversed([(f"^{c}$".replace(".", r"\."), k) for c, k, _ in scheme.roots] + list(scheme.kinds)):
        kind = F.when(F.col("citation").rlike(pattern), name).otherwise(kind)
    title = F.concat(F.lit(f"{scheme.label} "), F.col("citation"))
    for c, _, name in scheme.roots:
        title = F.when(F.col("citation") == c, name).otherwise(title)
    known = tree.select("doc_key", F.col("citation").alias("__p"))
    held = tree.withColumns({"citation_norm": F.upper("citation"), "kind": kind, "title": title, "__w": _parent(scheme.parent)})
    held = held.join(known.withColumnRenamed("doc_key", "__k"), (F.col("doc_key") == F.col("__k")) & (F.col("__w") == F.col("__p")), "left")
    return held.select("doc_key", "ordinal", "citation", "citation_norm", "kind", "title", F.when(F.col("body") != "", F.col("body")).alias("body"), F.upper("__p").alias("parent"))


def _parent(rule: str) -> Column:
    c = F.col("citation")
    if rule == "dotted":
        return dotted_parent(c)
    if rule == "cobit":
        return F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]*$", "")).when(F.length(c) > 3, F.substring(c, 1, 3))
    return F.lit(None).cast("string")


#: A point's lead-in, an amendment's citation, and what it says on the next line.
LEAD_IN = r"^(.+?)\s*(?:\[[CP](?:,\s*[CP])?\])?\s*[—–-]\s"
AMENDED, AMENDS = r"^(A\.)?\d+(\.\d+)*$", r"(?i)^(Add|Replace|Delete)\s+(the|a|this)\b"


def focus_points(tree: DataFrame) -> DataFrame:
    """Points of focus under criteria: a bullet opens one; its lead-in is what stands before a dash, less marks in brackets."""
    bullet = F.posexplode(F.split("body", r"\n?•\s+")).alias("n", "text")
    each = tree.filter("body is not null").select("doc_key", F.col("citation").alias("parent"), bullet).filter("n > 0")
    number = F.lpad(F.col("n").cast("string"), 2, "0")
    lead = F.regexp_extract("text", LEAD_IN, 1)
    return each.select("doc_key", "parent", F.concat("parent", F.lit("-pof-"), number).alias("citation"), lead.alias("title_original"), F.trim("text").alias("body"))


def amendment_tree(pages: DataFrame) -> DataFrame:
    """A clause for each instruction: a bare citation on a line, followed by Add, Replace or Delete and an article; its body runs to the next one.

    Trees with status, amends_citation_norm and amend_action beside the other columns, and no parents.
    """
    each = pages.select("doc_key", "page", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    order = Window.partitionBy("doc_key").orderBy("page", "no")
    after = F.lead("line").over(order)
    held = each.withColumn("action", F.when(F.col("line").rlike(AMENDED) & after.rlike(AMENDS), F.lower(F.regexp_extract(after, r"^(\w+)", 1))))
    held = held.withColumn("section", F.count("action").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("section > 0")
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col("action").isNull(), F.struct("page", "no", "line")))), lambda x: x["line"])
    rows = held.groupBy("doc_key", "section").agg(F.max(F.when(F.col("action").isNotNull(), F.col("line"))).alias("citation"), F.max("action").alias("amend_action"), F.array_join(told, "\n").alias("body"))
    return rows.select("doc_key", (F.col("section") - 1).cast("int").alias("ordinal"), "citation", F.upper("citation").alias("citation_norm"), F.lit("clause").alias("kind"), F.lit("active").alias("status"), F.concat(F.lit("Amendment change to clause "), "citation").alias("title"), "body", F.lit(None).cast("string").alias("parent"), F.col("citation").alias("amends_citation_norm"), "amend_action")


def amendments(pages: DataFrame) -> DataFrame:
    """doc_key, citation, action of an amendment's instructions."""
    return amendment_tree(pages).select("doc_key", "citation", F.col("amend_action").alias("action"))
