"""Edges between controls: resolving their targets in three passes, and reading them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The framework whose bare numbers may mean its annex, and known successors (from, to).
ANNEX_FRAMEWORK = "iso27001"
SUPERSESSIONS = (("ciscontrols", "v8.1", "ciscontrols", "v8"), ("csaccm", "v4.1", "csaccm", "v4.0"))


def noted(detail: Column, note: Column) -> Column:
    """detail with one more note; notes are parted by a semicolon."""
    return F.concat(detail, F.when(detail == "", "").otherwise("; "), note)


def _targets(controls: DataFrame, documents: DataFrame) -> DataFrame:
    """framework_code, version_label, citation_norm, kind, target_id: one per key, from a main document if any, the smallest id."""
    docs = documents.select(F.col("id").alias("document_id"), "framework_code", "version_label", "doc_role")
    held = controls.select(F.col("id").alias("target_id"), "document_id", "citation_norm", "kind").join(docs, "document_id")
    first = F.min(F.struct((F.col("doc_role") != "main").alias("other"), "target_id", "kind"))
    return held.groupBy("framework_code", "version_label", "citation_norm").agg(first.alias("t")).select("framework_code", "version_label", "citation_norm", "t.kind", "t.target_id")


def current_versions(versions: DataFrame) -> DataFrame:
    return versions.filter("is_current").groupBy("framework_code").agg(F.min("version_label").alias("current"))


def resolve_standard(edges: DataFrame, targets: DataFrame, current: DataFrame) -> DataFrame:
    """edges with `standard`: the target in the version an edge pins, or else in its framework's current one."""
    t = targets.select(F.col("framework_code").alias("to_framework_code"), F.col("version_label").alias("__version"), F.col("citation_norm").alias("to_citation_norm"), F.col("target_id").alias("standard"))
    c = current.select(F.col("framework_code").alias("to_framework_code"), F.col("current").alias("__current"))
    held = edges.join(c, "to_framework_code", "left").withColumn("__version", F.coalesce("to_version_label", "__current"))
    return held.join(t, ["to_framework_code", "__version", "to_citation_norm"], "left")


def resolve_annex(edges: DataFrame, targets: DataFrame, framework: str = ANNEX_FRAMEWORK, clause: str = "clause", annex: str = "annex-control", prefix: str = "A.") -> DataFrame:
    """edges with `annex`: a bare number as an annex control, unless a clause of that version bears the number itself. Needs __version."""
    own = targets.filter(F.col("framework_code") == framework)
    a = own.filter((F.col("kind") == annex) & F.col("citation_norm").startswith(prefix)).select(F.col("version_label").alias("__version"), F.col("citation_norm").substr(F.lit(len(prefix) + 1), F.length("citation_norm")).alias("to_citation_norm"), F.col("target_id").alias("__a"))
    clauses = own.filter(F.col("kind") == clause).select(F.col("version_label").alias("__version"), F.col("citation_norm").alias("to_citation_norm")).distinct()
    guarded = a.join(clauses, ["__version", "to_citation_norm"], "left_anti").groupBy("__version", "to_citation_norm").agg(F.min("__a").alias("__a"))
    held = edges.join(guarded, ["__version", "to_citation_norm"], "left")
    return held.withColumn("annex", F.when(F.col("to_framework_code") == framework, F.col("__a"))).drop("__a")


def resolve_supersession(edges: DataFrame, targets: DataFrame, relations: DataFrame) -> DataFrame:
    """edges with `successor` and `successor_version`: the target in a version that supersedes the pinned one, one hop only."""
    hop = relations.filter(F.col("relation_type") == "supersedes").select(F.col("to_framework_code"), F.col("to_version_label"), F.col("from_framework_code").alias("framework_code"), F.col("from_version_label").alias("version_label"))
    t = hop.join(targets, ["framework_code", "version_label"])
    t = t.groupBy("to_framework_code", "to_version_label", F.col("citation_norm").alias("to_citation_norm")).agg(F.min(F.struct("target_id", "version_label")).alias("s"))
    held = edges.join(t, ["to_framework_code", "to_version_label", "to_citation_norm"], "left")
    return held.withColumns({"successor": F.col("s.target_id"), "successor_version": F.col("s.version_label")}).drop("s")


def resolve(edges: DataFrame, controls: DataFrame, documents: DataFrame, versions: DataFrame, relations: DataFrame) -> DataFrame:
    """edges with to_control_id, resolved_by (standard, annex-prefix, supersession; null) and provenance_detail, all passes anew.

    Each pass is a left equi-join on one reduced target table, so an edge stays one row and is shuffled, not multiplied.
    """
    targets = _targets(controls, documents)
    held = resolve_standard(edges.drop("to_control_id"), targets, current_versions(versions))
    held = resolve_supersession(resolve_annex(held, targets), targets, relations)
    by = F.when(F.col("standard").isNotNull(), "standard").when(F.col("annex").isNotNull(), "annex-prefix").when(F.col("successor").isNotNull(), "supersession")
    norm = F.col("to_citation_norm")
    detail = F.when(by == "annex-prefix", noted(F.col("provenance_detail"), F.concat(F.lit("annex-prefix: resolved "), norm, F.lit(" as A."), norm)))
    detail = detail.when(by == "supersession", noted(F.col("provenance_detail"), F.concat(F.lit("version-supersession: cited "), F.col("to_version_label"), F.lit(" resolved in successor "), F.col("successor_version"))))
    out = held.withColumns({"to_control_id": F.coalesce("standard", "annex", "successor"), "resolved_by": by, "provenance_detail": detail.otherwise(F.col("provenance_detail"))})
    return out.select(*[c for c in edges.columns if c != "to_control_id"], "to_control_id", "resolved_by")


def structural_edges(controls: DataFrame) -> DataFrame:
    """from_id, to_norm both ways between A.x.y of one framework's annex and x.y of another's catalogue. controls: id, catalogue, citation_norm."""
    annex = controls.filter(F.col("citation_norm").startswith("A.")).select(F.col("id").alias("a"), F.col("citation_norm").alias("a_norm"), F.expr("substring(citation_norm, 3)").alias("norm"))
    bare = controls.filter(~F.col("citation_norm").startswith("A.")).select(F.col("id").alias("b"), F.col("citation_norm").alias("norm"))
    both = annex.join(bare, "norm")
    there = both.select(F.col("a").alias("from_id"), F.col("norm").alias("to_norm"), F.lit("equivalent").alias("relationship"))
    return there.unionByName(both.select(F.col("b").alias("from_id"), F.col("a_norm").alias("to_norm"), F.lit("equivalent").alias("relationship")))


def longest_equivalent(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """from_id, to_id, body: of each control's equivalents the longest body that is longer than its own; ties to the smaller id. bodies: id, body.

    Lengths decide, and only the winners' bodies are fetched.
    """
    own = bodies.select(F.col("id").alias("from_id"), F.coalesce(F.length("body"), F.lit(0)).alias("own"))
    sizes = bodies.select(F.col("id").alias("to_id"), F.length("body").alias("size"))
    held = edges.select("from_id", "to_id").join(sizes, "to_id").join(own, "from_id").filter(F.col("size") > F.col("own"))
    best = held.groupBy("from_id").agg(F.min(F.struct(-F.col("size"), "to_id")).alias("best")).select("from_id", F.col("best.to_id").alias("to_id"))
    return best.join(bodies.select(F.col("id").alias("to_id"), "body"), "to_id").select("from_id", "to_id", "body")


def outbound(edges: DataFrame, controls: DataFrame) -> DataFrame:
    """Edges with whether their target is known, and its title; an empty one where it is not."""
    t = controls.select(F.col("id").alias("to_control_id"), F.col("title").alias("resolved_title"))
    held = edges.join(t, "to_control_id", "left").withColumn("resolved", F.col("to_control_id").isNotNull())
    return held.withColumn("resolved_title", F.coalesce("resolved_title", F.lit("")))


def inbound(edges: DataFrame, controls: DataFrame) -> DataFrame:
    """Edges that reach a known control, with the citation they come from."""
    f = controls.select(F.col("id").alias("from_control_id"), F.col("citation").alias("from_citation"))
    return edges.filter("to_control_id is not null").join(f, "from_control_id")


def unresolved_groups(edges: DataFrame, controls: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Open edges by target and source, with their number and the frameworks that they come from; a null version is a group.

    An edge whose control or document is gone is in none. Edges are counted by group and framework first, so what is
    gathered for a group are the distinct frameworks, not its edges. controls: id, document_id. documents: id, framework_code.
    """
    keys = ["to_framework_code", "to_version_label", "to_citation_norm", "mapping_source_code"]
    docs = documents.select(F.col("id").alias("document_id"), "framework_code")
    source = controls.select(F.col("id").alias("from_control_id"), "document_id").join(docs, "document_id").select("from_control_id", "framework_code")
    by_framework = edges.filter("to_control_id is null").join(source, "from_control_id").groupBy(*keys, "framework_code").agg(F.count("*").alias("edges"))
    found = by_framework.groupBy(*keys).agg(F.sum("edges").alias("edges"), F.array_join(F.array_sort(F.collect_set("framework_code")), ", ").alias("from_frameworks"))
    found = found.withColumn("to_version_label", F.coalesce("to_version_label", F.lit("")))
    if limit is None:
        return found
    return found.orderBy(F.desc("edges"), "to_framework_code", "to_citation_norm", "to_version_label", "mapping_source_code").limit(limit)


#: What makes an edge, a document and a relation one and the same, and what of it a later row may change.
EDGE_KEY = ("from_control_id", "to_framework_code", "to_version_label", "to_citation_norm", "mapping_source_code")
EDGE_REPLACED = ("relationship", "provenance_detail")
DOCUMENT_KEY, DOCUMENT_REPLACED = ("doc_key",), ("title", "source_file_sha256", "serve_gate", "markdown")
RELATION_REPLACED, RELATION_KEY = ("note",), ("from_framework_code", "from_version_label", "to_framework_code", "to_version_label", "relation_type")


def rebuild_controls(controls: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Controls and edges after documents are rebuilt, those of new: their old controls go with the edges from them, edges to them stay open."""
    ids = new.select("document_id").distinct()
    gone = controls.join(ids, "document_id", "left_semi").select(F.col("id").alias("__gone")).distinct()
    kept = controls.join(ids, "document_id", "left_anti").unionByName(new)
    held = edges.join(gone, F.col("from_control_id") == F.col("__gone"), "left_anti").join(gone, F.col("to_control_id") == F.col("__gone"), "left")
    return kept, held.withColumn("to_control_id", F.when(F.col("__gone").isNull(), F.col("to_control_id"))).select(edges.columns)


def known_supersessions(spark: SparkSession) -> DataFrame:
    """The relations that come with the program, as rows to upsert."""
    rows = [(*s, "supersedes", f"{s[1]} supersedes {s[3]}") for s in SUPERSESSIONS]
    return spark.createDataFrame(rows, "from_framework_code string, from_version_label string, to_framework_code string, to_version_label string, relation_type string, note string")


def norms_to_ids(rows: DataFrame, controls: DataFrame, documents: DataFrame, versions: DataFrame, framework: str, norm: str = "citation_norm") -> DataFrame:
    """rows with control_id: the framework's control of that norm in the main document of its current version; null where there is none, which callers count."""
    docs = documents.filter((F.col("framework_code") == framework) & (F.col("doc_role") == "main")).join(versions.filter("is_current").select("framework_code", "version_label"), ["framework_code", "version_label"], "left_semi")
    ids = controls.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").groupBy(F.col("citation_norm").alias(norm)).agg(F.max("id").alias("control_id"))
    return rows.join(ids, norm, "left")


def crosswalk(pairs: DataFrame, controls: DataFrame, documents: DataFrame, versions: DataFrame, focal: str, target: str, version: str, source: str) -> tuple[DataFrame, Observation]:
    """A crosswalk's pairs (from_norm, to_norm, provenance) as edges from the focal framework's controls, not yet resolved, and how many pairs there were, with an unknown focal control, and with a known one."""
    held = norms_to_ids(pairs, controls, documents, versions, focal, "from_norm")
    seen, known = Observation(), F.col("control_id").isNotNull()
    held = held.observe(seen, F.count(F.lit(1)).alias("pairs"), F.count_if(~known).alias("unknown_focal"), F.count_if(known).alias("edges")).filter(known)
    return held.select(F.col("control_id").alias("from_control_id"), F.lit(target).alias("to_framework_code"), F.lit(version).alias("to_version_label"), F.col("to_norm").alias("to_citation_norm"), F.lit(source).alias("mapping_source_code"), F.lit("related").alias("relationship"), F.col("provenance").alias("provenance_detail")), seen


def dedupe_edges(edges: DataFrame, key: list[str]) -> DataFrame:
    """One edge for a key, nulls being equal, with all its sources' names in order."""
    return edges.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("source_name")), "; ").alias("sources"))


def _prefixed(lines: DataFrame) -> DataFrame:
    """from_id, prefix, rest of every line that is not blank; nulls where it has no colon."""
    each = lines.select("from_id", F.explode(F.split("text", "\n")).alias("line")).select("from_id", F.trim("line").alias("line")).filter("line <> ''")
    part = lambda pattern: F.when(F.contains("line", F.lit(":")), F.trim(F.regexp_extract("line", pattern, 1)))
    return each.select("from_id", part("^([^:]*):").alias("prefix"), part("^[^:]*:(.*)$").alias("rest"))


def prefix_references(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """from_id, prefix, rest, and what the part before a line's first colon stands for; to_framework_code null if unknown. lines: from_id, text."""
    each = _prefixed(lines).filter("prefix <> ''")
    return each.join(F.broadcast(sources.filter("enabled")), "prefix", "left")  # the vocabulary of sources has some tens of rows


def counted_references(lines: DataFrame, sources: DataFrame, citation: Callable[[Column, Column], Column]) -> tuple[DataFrame, Observation]:
    """Edges of reference lines, (from_id, to_framework_code, to_version_label, to_citation_norm), and what was left out on the way.

    citation: from prefix and rest the citation of a line, or null for one that names none. Counts are observed as the
    edges are read, so they cost no pass of their own and are there once an action has read the edges: lines, no_prefix
    (without a colon), unknown_prefix, skipped, edges, and skipped:<prefix> for each of the sources, which are some tens.
    """
    known = sources.filter("enabled")
    norm = F.upper(F.trim(citation(F.col("prefix"), F.col("rest"))))
    each = _prefixed(lines).join(F.broadcast(known), "prefix", "left").withColumn("to_citation_norm", norm)
    unknown, skipped = F.col("to_framework_code").isNull(), F.col("to_citation_norm").isNull()
    bare = F.col("prefix").isNull()
    seen = Observation()
    counts = {"lines": F.count(F.lit(1)), "no_prefix": F.count_if(bare), "unknown_prefix": F.count_if(~bare & unknown), "skipped": F.count_if(~unknown & skipped), "edges": F.count_if(~unknown & ~skipped)}
    counts |= {f"skipped:{r.prefix}": F.count_if(~unknown & skipped & (F.col("prefix") == r.prefix)) for r in known.select("prefix").collect()}
    found = each.observe(seen, *[c.alias(name) for name, c in counts.items()]).filter(~unknown & ~skipped)
    return found.select("from_id", "to_framework_code", "to_version_label", "to_citation_norm"), seen
