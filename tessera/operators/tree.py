"""The control tree and version lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable

def ancestors(controls: DataFrame) -> DataFrame:
    """id, path: citations of the ancestors, the root first, itself left out; it ends at a parent that is missing.

    Depth has no bound: in each round a control's pointer goes to where its target's pointer goes, so reach doubles, and
    rounds are the logarithm of the depth. Each is one join and is written; controls whose pointer has come to its end
    take no part in it. A control on a cycle or below one has no root, and a null path. Columns: id, parent_id, citation.
    """
    own = F.struct("id", "citation")
    held = controls.select("id", F.col("parent_id").alias("at"), own.alias("self"), F.slice(F.array(own), 1, 0).alias("above"), F.lit(False).alias("cyclic"))
    while True:
        held = durable(held, "ancestors")
        live, ended = held.filter("at is not null"), held.filter("at is null")
        if live.isEmpty():
            return held.select("id", F.when(~F.col("cyclic"), F.transform("above", lambda x: x["citation"])).alias("path"))
        up = held.select(F.col("id").alias("__id"), F.col("at").alias("__at"), F.array_append("above", F.col("self")).alias("__chain"), F.col("cyclic").alias("__cyclic"))
        held = live.join(up, F.col("at") == F.col("__id"), "left").withColumn("above", F.concat(F.coalesce("__chain", F.slice("above", 1, 0)), "above"))
        ids = F.transform(F.array_append("above", F.col("self")), lambda x: x["id"])
        held = held.withColumn("cyclic", F.coalesce("__cyclic", F.lit(False)) | (F.size(F.array_distinct(ids)) < F.size(ids)))
        held = ended.unionByName(held.select("id", F.when(~F.col("cyclic"), F.col("__at")).alias("at"), "self", "above", "cyclic"))


def parents(controls: DataFrame) -> DataFrame:
    """Controls with their parent's citation and title."""
    p = controls.select(F.col("id").alias("parent_id"), F.col("citation").alias("parent_citation"), F.col("title").alias("parent_title"))
    return controls.join(p, "parent_id", "left")


def children(controls: DataFrame, parent: Column, limit: int = 500) -> DataFrame:
    return controls.filter(F.col("parent_id") == parent).orderBy("ordinal", "id").limit(limit)


def by_prefix(controls: DataFrame, parent_citation: Column) -> DataFrame:
    """Controls with the id of the one whose citation is parent_citation; null where there is none."""
    p = controls.select(F.col("id").alias("parent_id"), F.col("citation").alias("__p"))
    return controls.drop("parent_id").withColumn("__p", parent_citation).join(p, "__p", "left").drop("__p")


def carry_header(rows: DataFrame, group: str, order: str, is_header: Column, value: Column, name: str = "header") -> DataFrame:
    """Rows with the last header's value at or above them."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(is_header, value), ignorenulls=True).over(w))


def sections(rows: DataFrame, group: str, order: str, is_header: Column, name: str = "section") -> DataFrame:
    """Rows with the number of headers at or above them: each header opens a section."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(is_header, 1).otherwise(0)).over(w))


def first_sighting(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def lineage(relations: DataFrame, versions: DataFrame, framework: str, version: str) -> DataFrame:
    """block, kind, framework_code, version_label, relation_type, is_current, note: relations of a version from its own side, then all its framework's versions."""
    own = (F.col("from_framework_code") == framework) & (F.col("from_version_label") == version)
    met = (F.col("to_framework_code") == framework) & (F.col("to_version_label") == version)
    side = relations.filter(own | met).select(
        F.lit(0).alias("block"), F.when(own, "from").otherwise("to").alias("kind"),
        F.when(own, F.col("to_framework_code")).otherwise(F.col("from_framework_code")).alias("framework_code"),
        F.when(own, F.col("to_version_label")).otherwise(F.col("from_version_label")).alias("version_label"),
        "relation_type", "note")
    side = side.join(versions.select("framework_code", "version_label", "is_current"), ["framework_code", "version_label"], "left")
    side = side.select("block", "kind", "framework_code", "version_label", "relation_type", F.coalesce("is_current", F.lit(False)).alias("is_current"), "note")
    known = versions.filter(F.col("framework_code") == framework).select(F.lit(1).alias("block"), F.lit("version").alias("kind"), "framework_code", "version_label", F.lit("").alias("relation_type"), "is_current", F.col("edition_note").alias("note"))
    return side.unionByName(known)


def amendments(controls: DataFrame, documents: DataFrame, framework: str, version: str, citation_norm: str) -> DataFrame:
    docs = documents.filter((F.col("framework_code") == framework) & (F.col("version_label") == version) & (F.col("doc_role") == "amendment")).select(F.col("id").alias("document_id"), "qualifier", "doc_key")
    held = controls.filter(F.col("amends_citation_norm") == citation_norm).join(F.broadcast(docs), "document_id")
    return held.select("citation", F.coalesce("amend_action", F.lit("")).alias("action"), "qualifier", "doc_key", "title", F.coalesce("body", F.lit("")).alias("body")).orderBy("qualifier", "citation")


def pick_control(controls: DataFrame, documents: DataFrame, versions: DataFrame, citation: Column, padded: Column, framework: str = "", version: str = "") -> DataFrame:
    """The control that a citation opens, at most one: current versions first, then main documents, framework, citation and id. Withdrawn ones open too."""
    named = controls.filter((F.col("citation_norm") == F.upper(citation)) | (F.col("citation_norm") == F.upper(padded)))
    docs = documents.select(F.col("id").alias("document_id"), "framework_code", "version_label", "doc_role")
    held = named.join(docs, "document_id").join(versions.select("framework_code", "version_label", "is_current"), ["framework_code", "version_label"])
    if framework:
        held = held.filter(F.col("framework_code") == framework)
    held = held.filter(F.col("version_label") == version) if version else held.filter("is_current")
    return held.orderBy(F.desc("is_current"), F.desc(F.col("doc_role") == "main"), "framework_code", "citation_norm", "id").limit(1)


def source_urls(documents: DataFrame, source_files: DataFrame) -> DataFrame:
    """id, source_url: the least non-empty url of a document's file, or an empty one."""
    least = source_files.filter("source_url <> ''").groupBy("sha256").agg(F.min("source_url").alias("source_url"))
    held = documents.select("id", F.col("source_file_sha256").alias("sha256")).join(least, "sha256", "left")
    return held.select("id", F.coalesce("source_url", F.lit("")).alias("source_url"))


def curated_titles(controls: DataFrame, titles: DataFrame, framework: str, version: str) -> DataFrame:
    """Controls of a version with the curated title, where there is one, in place of their own. titles: registry rows of all versions."""
    own = titles.filter((F.col("framework_code") == framework) & (F.col("version_label") == version)).select("citation_norm", F.col("title").alias("__curated"))
    held = controls.join(own, "citation_norm", "left").withColumn("title", F.coalesce("__curated", "title"))
    return held.select(controls.columns)
