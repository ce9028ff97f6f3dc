"""Corpus status and quality gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("documents", "controls", "withdrawn", "chunks", "embeddings", "mapping_edges", "resolved", "unresolved", "inbound_edges")
CATEGORIES = ("unresolved_mappings", "deferred_docs", "manifest", "body_quality", "eval_floors")


def status_rows(versions: DataFrame, documents: DataFrame, controls: DataFrame, chunks: DataFrame, embeddings: DataFrame, edges: DataFrame) -> DataFrame:
    """COUNTS of every (framework_code, version_label) that has a document or a control.

    Six aggregates, each by its own path to the version, joined at the size of the versions. Keys: documents.id,
    controls.(id, document_id, status), chunks.(id, control_id), embeddings.chunk_id, edges.(from_control_id, to_control_id).
    """
    key = ["framework_code", "version_label"]
    docs = documents.select(F.col("id").alias("document_id"), *key)
    placed = controls.select(F.col("id").alias("control_id"), "document_id", "status").join(docs, "document_id").select("control_id", "status", *key)
    by_chunk = chunks.select(F.col("id").alias("chunk_id"), "control_id").join(placed.drop("status"), "control_id")
    n = lambda name: F.count("*").alias(name)
    parts = [
        docs.groupBy(*key).agg(n("documents")),
        placed.groupBy(*key).agg(n("controls"), F.count_if(F.col("status") == "withdrawn").alias("withdrawn")),
        by_chunk.groupBy(*key).agg(n("chunks")),
        embeddings.select("chunk_id").join(by_chunk, "chunk_id").groupBy(*key).agg(n("embeddings")),
        edges.join(placed.withColumnRenamed("control_id", "from_control_id"), "from_control_id").groupBy(*key).agg(n("mapping_edges"), F.count("to_control_id").alias("resolved"), F.count_if(F.col("to_control_id").isNull()).alias("unresolved")),
        edges.select("to_control_id").join(placed.withColumnRenamed("control_id", "to_control_id"), "to_control_id").groupBy(*key).agg(n("inbound_edges")),
    ]
    held = versions
    for part in parts:
        held = held.join(part, key, "left")
    held = held.fillna(0, list(COUNTS))
    return held.filter("documents > 0 or controls > 0")


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("framework_code").alias("frameworks"), F.count("*").alias("versions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])


def notes(totals: dict) -> list[str]:
    """What a reader of the totals should know."""
    out = []
    if totals["chunks"] and not totals["embeddings"]:
        out.append("There are no dense embeddings: search is lexical only until the corpus is embedded.")
    if not totals["chunks"]:
        out.append("There are no chunks: build the corpus before searching it.")
    if totals["unresolved"]:
        out.append(f"{totals['unresolved']} mapping edges have no target yet; their framework or version may not be loaded.")
    if totals["withdrawn"]:
        out.append(f"{totals['withdrawn']} controls are withdrawn; search leaves them out unless asked for them.")
    return out


def deferred_documents(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Recognised files without a document, and why."""
    key = ["framework_code", "version_label", "doc_role", "qualifier"]
    asked = manifest.filter(F.col("framework_code").isNotNull() & ~F.col("ignored") & ~F.col("doc_role").isin("guide", "changelog"))
    asked = asked.withColumn("qualifier", F.coalesce("qualifier", F.lit("")))
    reason = F.when(F.col("doc_role") == "amendment", "amendment parsing deferred").when(F.col("doc_role") == "companion-workbook", "companion-workbook parsing deferred").otherwise("parsing not yet implemented")
    return asked.join(documents.select(*key), key, "left_anti").select(*key, reason.alias("reason"))


def manifest_status(framework: Column, ignored: Column, error: Column) -> Column:
    return F.when(framework.isNull() & ~ignored, "unrecognized").when(F.coalesce(error, F.lit("")) != "", "error").otherwise("ok")


def manifest_gaps(manifest: DataFrame) -> DataFrame:
    """rel_path, sha256, status, error of files that no rule knows or a stage failed on; removed ones too."""
    held = manifest.withColumn("gap", manifest_status(F.col("framework_code"), F.col("ignored"), F.col("stage_error")))
    return held.filter("gap <> 'ok'").select("rel_path", F.coalesce("sha256", F.lit("")).alias("sha256"), F.col("gap").alias("status"), F.coalesce("stage_error", F.lit("")).alias("error"))


LISTINGS = ("active", "unrecognized", "ignored")


def listing(manifest: DataFrame, kind: str) -> DataFrame:
    """Active files, all or those that no rule knows or a rule says to ignore, in order of their path."""
    if kind not in LISTINGS:
        raise ValueError(f"unknown listing {kind!r}; known: {', '.join(LISTINGS)}")
    held = manifest.filter("status = 'active'")
    if kind != "active":
        held = held.filter(F.col("ignored") if kind == "ignored" else ~F.col("ignored") & F.col("framework_code").isNull())
    return held.orderBy("rel_path")


#: What each listing of the registry and of the corpus keeps, and its order.
REGISTRY = {
    "frameworks": ("true", ("code",)), "versions": ("true", ("framework_code", "version_label")), "current_versions": ("is_current", ("framework_code",)), "mapping_sources": ("true", ("code",)), "control_kinds": ("true", ("code",)),
    "file_rules": ("true", ("ordinal",)), "reference_sources": ("enabled", ("prefix",)), "control_titles": ("true", ("citation_norm",)), "documents": ("true", ("framework_code", "version_label", "doc_role", "qualifier")), "relations": ("true", ("from_framework_code", "from_version_label")), "controls": ("true", ("ordinal", "id")),
}


def listed(kind: str, table: DataFrame, **keys) -> DataFrame:
    """A listing of REGISTRY in its order, of the rows whose columns have the values given."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown listing {kind!r}; known: {', '.join(REGISTRY)}")
    keep, order = REGISTRY[kind]
    return lookup(table, **keys).filter(keep).orderBy(*order)


def lookup(table: DataFrame, **keys) -> DataFrame:
    """The rows whose columns have these values, null being one; a key names one row at most."""
    for name, value in keys.items():
        table = table.filter(F.col(name).eqNullSafe(F.lit(value)))
    return table


def categories(category: str = "") -> list[str]:
    """The categories that a name stands for; an unknown one is an error."""
    name = category.strip().lower()
    if name in ("", "all"):
        return list(CATEGORIES)
    if name not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}; known: {', '.join(CATEGORIES)}, all")
    return [name]


def clamp_limit(asked: int, default: int, most: int) -> int:
    return default if asked <= 0 else min(asked, most)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page, and one row with next_offset, null on the last page: one row more than the page is looked at."""
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    more = ahead.agg(F.when(F.count("*") > limit, F.lit(offset + limit)).alias("next_offset"))
    return ahead.orderBy(*order).limit(limit), more


def framework_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("framework_code").agg(F.array_sort(F.collect_set("version_label")).alias("versions"))
