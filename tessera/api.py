"""What a reader of the corpus asks: a control's dossier, the corpus' status, its gaps. Search is in operators.retrieval.

A corpus is a mapping of table names to DataFrames: frameworks, versions, documents, controls, edges, relations,
chunks, embeddings, manifest, source_files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions.citations import clean_citation, zero_pad
from tessera.operators import evaluation, mapping, status, tree

SECTIONS = ("children", "mappings", "lineage", "chunks")
#: How many chunks and gaps a caller gets by default and at most, and how many other versions are named.
CHUNKS, MOST_CHUNKS, GAPS, MOST_GAPS, OTHERS = 20, 50, 20, 100, 10

GUIDE = {
    "search": "Ask in words or name a citation; pin a framework or a version to narrow it.",
    "document": "Open one control by its citation, with its children, mappings, lineage and chunks.",
    "status": "See which versions are loaded, and how much of them.",
    "gaps": "See what is missing: open edges, deferred files, unknown files.",
}
CAVEATS = (
    {"scheme": "pages", "caveat": "Bodies come from page text: tables and columns may be cut or run together."},
    {"scheme": "workbooks", "caveat": "Cells are taken as they are shown; numbers that a workbook has mangled are matched by title."},
)


def sections(include: Sequence[str] | None) -> tuple[str, ...]:
    """The sections asked for, all by default; an unknown one is an error."""
    unknown = set(include or ()) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections {sorted(unknown)}; known: {', '.join(SECTIONS)}")
    return tuple(include) if include else SECTIONS


def _bearing(corpus: Mapping[str, DataFrame], citation: str) -> DataFrame:
    """framework_code, version_label, is_current of documents that have the citation."""
    named = corpus["controls"].filter((F.col("citation_norm") == F.upper(clean_citation(F.lit(citation)))) | (F.col("citation_norm") == F.upper(zero_pad(clean_citation(F.lit(citation))))))
    docs = corpus["documents"].select(F.col("id").alias("document_id"), "framework_code", "version_label")
    return named.join(docs, "document_id").join(corpus["versions"].select("framework_code", "version_label", "is_current"), ["framework_code", "version_label"], "left").select("framework_code", "version_label", "is_current").distinct()


def other_versions(corpus: Mapping[str, DataFrame], citation: str, framework: str = "") -> list[str]:
    held = _bearing(corpus, citation)
    held = held.filter(F.col("framework_code") == framework) if framework else held
    return [r[0] for r in held.select(F.concat_ws(" ", "framework_code", "version_label").alias("v")).distinct().orderBy("v").limit(OTHERS).collect()]


def other_frameworks(corpus: Mapping[str, DataFrame], citation: str, framework: str) -> list[str]:
    held = _bearing(corpus, citation).filter(F.col("is_current") & (F.col("framework_code") != framework))
    return [r[0] for r in held.select("framework_code").distinct().orderBy("framework_code").limit(OTHERS).collect()]


def document(corpus: Mapping[str, DataFrame], citation: str, framework: str = "", version: str = "", include: Sequence[str] | None = None, limit: int = 0, offset: int = 0) -> dict:
    """The dossier of the control that a citation opens: its row, gaps, and a DataFrame for each section."""
    wanted = sections(include)
    limit = status.clamp_limit(limit, CHUNKS, MOST_CHUNKS)
    clean = clean_citation(F.lit(citation))
    found = tree.pick_control(corpus["controls"], corpus["documents"], corpus["versions"], clean, zero_pad(clean), framework, version).collect()
    out: dict = {"found": bool(found), "gaps": [], "limit": limit, "offset": max(offset, 0)}
    if not found:
        out["gaps"].append({"kind": "no_evidence", "blocks": True})
        if version and (known := other_versions(corpus, citation, framework)):
            out["gaps"].append({"kind": "version_not_found", "blocks": True, "found_in": known})
        if framework and (others := other_frameworks(corpus, citation, framework)):
            out["gaps"].append({"kind": "found_elsewhere", "blocks": False, "found_in": others})
        return out
    control = found[0]
    out["control"] = control.asDict()
    if not framework and (others := other_frameworks(corpus, citation, control.framework_code)):
        out["gaps"].append({"kind": "ambiguous_citation", "blocks": False, "found_in": others})
    out["amendments"] = tree.amendments(corpus["controls"], corpus["documents"], control.framework_code, control.version_label, control.citation_norm)
    out["parent"] = corpus["controls"].filter(F.col("id") == F.lit(control.parent_id).cast("long"))
    if "children" in wanted:
        out["children"] = tree.children(corpus["controls"], F.lit(control.id))
    if "mappings" in wanted:
        out["outbound"] = mapping.outbound(corpus["edges"].filter(F.col("from_control_id") == control.id), corpus["controls"])
        out["inbound"] = mapping.inbound(corpus["edges"].filter(F.col("to_control_id") == control.id), corpus["controls"])
    if "lineage" in wanted:
        out["lineage"] = tree.lineage(corpus["relations"], corpus["versions"], control.framework_code, control.version_label)
    if "chunks" in wanted:
        own = corpus["chunks"].filter(F.col("control_id") == control.id)
        out["chunks"], ahead = status.page(own, ["ordinal", "id"], limit, out["offset"])
        out["next_offset"] = ahead.first()["next_offset"]
        if own.isEmpty():
            out["gaps"].append({"kind": "no_chunks", "blocks": False})
    return out


#: How many rows of a kind a dossier of many lists; it counts all.
LISTED = 500


def _listed(rows: DataFrame, order: list[Column], what: Column, name: str, most: int = LISTED) -> DataFrame:
    """query_id, name (the first `most` in order) and n_name. The limit of the window stands before the shuffle, so no array takes more."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    first = rows.select("query_id", what.alias("what"), place.alias("place")).filter(F.col("place") <= most)
    arrays = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "what"))), lambda x: x["what"]).alias(name))
    return rows.groupBy("query_id").agg(F.count("*").alias(f"n_{name}")).join(arrays, "query_id")


def dossiers(corpus: Mapping[str, DataFrame], asked: DataFrame, limit: int = 0) -> DataFrame:
    """document() for many citations in one job: a row for each, its lists as arrays of structs in order.

    asked: query_id, citation, and as they like framework and version. Columns: query_id, found, control (null where
    nothing is found), gaps, children, outbound, inbound, lineage, amendments, chunks, a number n_ of each, more_chunks.
    Every part is a join with the controls that were picked, and a window that keeps so many; nothing is collected.
    """
    limit = status.clamp_limit(limit, CHUNKS, MOST_CHUNKS)
    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in asked.columns else F.lit("")
    clean = clean_citation(F.col("citation"))
    queries = asked.select("query_id", F.upper(clean).alias("clean"), F.upper(zero_pad(clean)).alias("padded"), given("framework").alias("framework"), given("version").alias("version"))
    docs = corpus["documents"].select(F.col("id").alias("document_id"), "framework_code", "version_label", "doc_role")
    versions = corpus["versions"].select("framework_code", "version_label", "is_current")
    named = queries.select("query_id", "framework", "version", F.explode(F.array_distinct(F.array("clean", "padded"))).alias("citation_norm"))
    bearing = named.join(corpus["controls"], "citation_norm").join(docs, "document_id").join(versions, ["framework_code", "version_label"], "left")
    bearing = durable(bearing, "bearing")
    fits = F.col("is_current").isNotNull() & ((F.col("framework") == "") | (F.col("framework_code") == F.col("framework"))) & F.when(F.col("version") != "", F.col("version_label") == F.col("version")).otherwise(F.col("is_current"))
    order = [F.desc("is_current"), F.desc(F.col("doc_role") == "main"), "framework_code", "citation_norm", "id"]
    own = ["id", "document_id", "framework_code", "version_label", "citation", "citation_norm", "kind", "status", "title", "body", "parent_id"]
    picked = bearing.filter(fits).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter("n = 1")
    picked = durable(picked.select("query_id", F.col("framework").alias("asked_framework"), F.struct(*own).alias("control")), "picked")
    of = picked.select("query_id", F.col("control.id").alias("control_id"), F.col("control.framework_code").alias("f"), F.col("control.version_label").alias("v"), F.col("control.citation_norm").alias("norm"))

    controls, edges = corpus["controls"], corpus["edges"]
    below = of.join(controls, F.col("parent_id") == F.col("control_id"))
    out = mapping.outbound(of.join(edges, F.col("from_control_id") == F.col("control_id")).drop("control_id"), controls)
    into = mapping.inbound(of.join(edges.drop("control_id") if "control_id" in edges.columns else edges, F.col("to_control_id") == F.col("control_id")).drop("control_id"), controls)
    edge = F.struct("to_framework_code", F.coalesce("to_version_label", F.lit("")).alias("to_version_label"), "to_citation_norm", "resolved", "resolved_title", "mapping_source_code")
    relations = corpus["relations"]
    from_side = of.join(relations, (F.col("from_framework_code") == F.col("f")) & (F.col("from_version_label") == F.col("v"))).select("query_id", F.lit("from").alias("kind"), F.col("to_framework_code").alias("framework_code"), F.col("to_version_label").alias("version_label"), "relation_type", "note")
    to_side = of.join(relations, (F.col("to_framework_code") == F.col("f")) & (F.col("to_version_label") == F.col("v")) & ~((F.col("from_framework_code") == F.col("f")) & (F.col("from_version_label") == F.col("v")))).select("query_id", F.lit("to").alias("kind"), F.col("from_framework_code").alias("framework_code"), F.col("from_version_label").alias("version_label"), "relation_type", "note")
    sides = from_side.unionByName(to_side).join(versions, ["framework_code", "version_label"], "left").withColumns({"block": F.lit(0), "is_current": F.coalesce("is_current", F.lit(False))})
    known = of.join(corpus["versions"], F.col("framework_code") == F.col("f")).select("query_id", F.lit(1).alias("block"), F.lit("version").alias("kind"), "framework_code", "version_label", F.lit("").alias("relation_type"), "is_current", F.col("edition_note").alias("note"))
    lineage = sides.select(known.columns).unionByName(known)
    amending = corpus["documents"].filter("doc_role = 'amendment'").select(F.col("id").alias("document_id"), "framework_code", "version_label", "qualifier", "doc_key")
    amended = of.join(controls.filter("amends_citation_norm is not null"), F.col("amends_citation_norm") == F.col("norm")).join(amending, "document_id").filter((F.col("framework_code") == F.col("f")) & (F.col("version_label") == F.col("v")))
    chunk = of.join(corpus["chunks"].withColumnRenamed("id", "chunk_id"), "control_id")
    parts = {
        "children": _listed(below, ["ordinal", "id"], F.struct("id", "citation", "title", "kind", "status"), "children"),
        "outbound": _listed(out, ["to_framework_code", "to_citation_norm", F.asc_nulls_first("to_version_label"), "mapping_source_code"], edge, "outbound"),
        "inbound": _listed(into, ["from_citation", "from_control_id", "mapping_source_code"], F.struct("from_control_id", "from_citation", "mapping_source_code"), "inbound"),
        "lineage": _listed(lineage, ["block", "kind", "framework_code", "version_label", "relation_type"], F.struct("kind", "framework_code", "version_label", "relation_type", "is_current", "note"), "lineage"),
        "amendments": _listed(amended, ["qualifier", "citation"], F.struct("citation", F.coalesce("amend_action", F.lit("")).alias("action"), "qualifier", "doc_key", "title", F.coalesce("body", F.lit("")).alias("body")), "amendments"),
        "chunks": _listed(chunk, ["ordinal", "chunk_id"], F.struct("chunk_id", "content", "ordinal"), "chunks", limit),
    }

    elsewhere = bearing.join(picked.select("query_id", F.col("control.framework_code").alias("own")), "query_id", "left")
    few = lambda rows, what, name: rows.select("query_id", what.alias("what")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("what"))).filter(F.col("n") <= OTHERS).groupBy("query_id").agg(F.array_sort(F.collect_list("what")).alias(name))
    others = few(elsewhere.filter(F.coalesce("is_current", F.lit(False)) & (F.col("framework_code") != F.coalesce("own", "framework"))), F.col("framework_code"), "others")
    in_versions = few(elsewhere.filter("framework = '' or framework_code = framework"), F.concat_ws(" ", "framework_code", "version_label"), "in_versions")
    held = queries.select("query_id", "framework", "version").join(picked.select("query_id", "control"), "query_id", "left").join(others, "query_id", "left").join(in_versions, "query_id", "left")
    for part in parts.values():
        held = held.join(part, "query_id", "left")
    found = F.col("control").isNotNull()
    none = F.lit(None).cast("array<string>")
    gap = lambda when, kind, blocks, found_in=none: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(blocks).alias("blocks"), found_in.alias("found_in")))
    gaps = F.array_compact(F.array(
        gap(~found, "no_evidence", True), gap(~found & (F.col("version") != "") & F.col("in_versions").isNotNull(), "version_not_found", True, F.col("in_versions")),
        gap(~found & (F.col("framework") != "") & F.col("others").isNotNull(), "found_elsewhere", False, F.col("others")),
        gap(found & (F.col("framework") == "") & F.col("others").isNotNull(), "ambiguous_citation", False, F.col("others")), gap(found & F.col("n_chunks").isNull(), "no_chunks", False)))
    counts = [F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in parts]
    return held.select("query_id", found.alias("found"), "control", gaps.alias("gaps"), *parts, *counts, (F.coalesce("n_chunks", F.lit(0)) > limit).alias("more_chunks"))


def corpus_status(corpus: Mapping[str, DataFrame]) -> dict:
    names = corpus["frameworks"].select(F.col("code").alias("framework_code"), F.col("name").alias("framework_name"), "serve_policy")
    versions = corpus["versions"].select("framework_code", "version_label", "is_current").join(names, "framework_code")
    rows = status.status_rows(versions, corpus["documents"], corpus["controls"], corpus["chunks"], corpus["embeddings"], corpus["edges"])
    total = status.totals(rows).first().asDict()
    return {"search_ready": total["chunks"] > 0, "frameworks": rows.orderBy("framework_code", "version_label"), "totals": total, "notes": status.notes(total)}


def quality_gaps(corpus: Mapping[str, DataFrame], category: str = "", limit: int = 0) -> dict:
    limit = status.clamp_limit(limit, GAPS, MOST_GAPS)
    wanted = status.categories(category)
    out: dict = {"limit": limit, "categories": wanted}
    if "unresolved_mappings" in wanted:
        out["unresolved_mappings"] = mapping.unresolved_groups(corpus["edges"], corpus["controls"], corpus["documents"], limit)
    if "deferred_docs" in wanted:
        out["deferred_docs"] = status.deferred_documents(corpus["manifest"], corpus["documents"]).orderBy("framework_code", "version_label", "doc_role", "qualifier").limit(limit)
    if "manifest" in wanted:
        out["manifest"] = status.manifest_gaps(corpus["manifest"]).orderBy("rel_path").limit(limit)
    if "body_quality" in wanted:
        out["body_quality"] = list(CAVEATS)
    if "eval_floors" in wanted:
        out["eval_floors"] = dict(evaluation.FLOORS)
    return out
