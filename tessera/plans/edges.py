"""Mapping edges and lineage over the driver's tables: lineitem rows are edges to parts, which are controls."""

from __future__ import annotations

import functools
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import api
from tessera.durable import durable, shared_dir
from tessera.functions.citations import category_parent, csf_target, dotted_order, dotted_parent, iso_reference, iso_target, sp80053_target, title_key
from tessera.operators import mapping, numbering, tree
from tessera.plans.tables import read
from tessera.published import Published
from tessera.sources import workbooks

#: Parts over this size are not loaded, so that edges to them stay open.
LOADED = 35
VERSIONS = [("iso27001", "N", True), ("iso27001", "R", False), ("ciscontrols", "N", True), ("ciscontrols", "R", False)]
RELATIONS = [("ciscontrols", "N", "ciscontrols", "A", "supersedes", "N replaces A"), ("iso27001", "N", "iso27001", "R", "amends", "N amends R")]


def controls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Controls, documents, versions, relations. A part is in document 1 to 4 by its key, a third of those of some sizes in the annex."""
    parts = read(spark, sf_dir, "part").filter(F.col("p_size") <= LOADED)
    number = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 40).cast("string"))
    annex = (F.col("p_partkey") % 3 == 0) & (F.col("p_size") % 5 == 0)
    held = parts.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4 + 1).alias("document_id"), F.when(annex, F.concat(F.lit("A."), number)).otherwise(number).alias("citation_norm"), F.when(annex, "annex-control").otherwise("clause").alias("kind"), F.col("p_name").alias("citation"))
    docs = spark.createDataFrame([(k + 1, f, v, "main") for k, (f, v, _) in enumerate(VERSIONS)], "id long, framework_code string, version_label string, doc_role string")
    versions = spark.createDataFrame(VERSIONS, "framework_code string, version_label string, is_current boolean")
    relations = spark.createDataFrame(RELATIONS, "from_framework_code string, from_version_label string, to_framework_code string, to_version_label string, relation_type string, note string")
    return held, docs, versions, relations


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per distinct target of each order: lineitem has repeated rows, an edge key has not."""
    lines = read(spark, sf_dir, "lineitem")
    size = (F.col("l_partkey") % 50 + 1).cast("string")
    return lines.select(
        F.col("l_orderkey").alias("from_control_id"), F.when(F.col("l_suppkey") % 2 == 0, "iso27001").otherwise("ciscontrols").alias("to_framework_code"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("to_version_label"), F.concat(size, F.lit("."), (F.col("l_partkey") % 40).cast("string")).alias("to_citation_norm"),
        F.col("l_linestatus").alias("mapping_source_code"), F.lit("row").alias("provenance_detail")).distinct()


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, docs, versions, relations = controls(spark, sf_dir)
    return mapping.resolve(edges(spark, sf_dir), held, docs, versions, relations)


_EDGE = ("from_control_id", "to_framework_code", "to_version_label", "to_citation_norm", "mapping_source_code")


def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, docs, versions, _ = controls(spark, sf_dir)
    return mapping.resolve_standard(edges(spark, sf_dir), mapping._targets(held, docs), mapping.current_versions(versions)).select(*_EDGE, F.col("standard").alias("to_control_id"))


def resolve_annex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("resolved_by = 'annex-prefix'").select(*_EDGE, "to_control_id", "provenance_detail")


def resolve_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("resolved_by = 'supersession'").select(*_EDGE, "to_control_id", "provenance_detail")


def resolve_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("to_framework_code", F.coalesce("resolved_by", F.lit("open")).alias("resolved_by")).agg(F.count("*").alias("edges"), F.count_distinct("to_control_id").alias("targets"))


def unresolved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are the controls that edges come from, customers' segments their frameworks; some orders' customers are no documents."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"))
    docs = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("framework_code"))
    return mapping.unresolved_groups(_resolved(spark, sf_dir), orders, docs, 50)


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nations ask for, a number, a third of them of one framework and a quarter of an old version: the control that it opens, with what hangs on it."""
    held, docs, versions, relations = controls(spark, sf_dir)
    empty = lambda kind: F.lit(None).cast(kind)
    held = held.withColumns({"title": F.col("citation"), "status": F.lit("active"), "body": empty("string"), "parent_id": (F.col("id") / 20).cast("long"), "ordinal": F.col("id") % 5, "amends_citation_norm": empty("string"), "amend_action": empty("string")})
    docs = docs.withColumns({"qualifier": F.lit(""), "doc_key": F.concat_ws("|", "framework_code", "version_label")})
    chunk = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 300).alias("control_id"), F.col("lang").alias("content"), F.lit(0).alias("ordinal"))
    corpus = {"controls": held, "documents": docs, "versions": versions.withColumn("edition_note", F.lit("")), "relations": relations, "edges": durable(_resolved(spark, sf_dir), "edges"), "chunks": chunk}
    k = F.col("n_nationkey")
    asked = read(spark, sf_dir, "nation").select(k.alias("query_id"), F.concat((k % 11 + 1).cast("string"), F.lit("."), (k * 7 % 40).cast("string")).alias("citation"), F.when(k % 3 == 1, "iso27001").when(k % 6 == 2, "none").otherwise("").alias("framework"), F.when(k % 4 == 3, "R").otherwise("").alias("version"))
    found = api.dossiers(corpus, asked)
    listed = lambda column, of: F.array_join(F.transform(column, of), ",")
    return found.select(
        "query_id", "found", F.col("control.id").alias("control_id"), F.col("control.framework_code").alias("framework_code"), F.col("control.version_label").alias("version_label"), listed("gaps", lambda g: F.concat_ws(":", g["kind"], F.array_join(g["found_in"], "/"))).alias("gaps"),
        listed("children", lambda c: c["id"].cast("string")).alias("children"), F.col("n_outbound"), listed("outbound", lambda e: F.concat_ws("|", e["to_framework_code"], e["to_citation_norm"], e["resolved_title"])).alias("outbound"), "n_inbound", listed("lineage", lambda x: F.concat_ws(" ", x["kind"], x["version_label"], x["relation_type"])).alias("lineage"),
        listed("chunks", lambda c: c["chunk_id"].cast("string")).alias("chunks"), "n_chunks", "more_chunks")


def outbound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, *_ = controls(spark, sf_dir)
    return mapping.outbound(_resolved(spark, sf_dir), held.withColumn("title", F.col("citation"))).select(*_EDGE, "to_control_id", "resolved_title", "resolved")


def inbound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("citation"))
    return mapping.inbound(_resolved(spark, sf_dir), orders).groupBy("to_control_id", "from_citation").agg(F.count("*").alias("edges"))


def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, *_ = controls(spark, sf_dir)
    return mapping.structural_edges(held)


def longest_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source and language are each other's equivalents, along a ring of neighbours by id."""
    docs = read(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").alias("from_id"), F.explode(F.array(*[F.col("doc_id") + 20 * k for k in (1, 2, 3)])).alias("to_id"))
    found = mapping.longest_equivalent(pairs, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return found.select("from_id", "to_id", F.length("body").cast("long").alias("length"))


def version_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts as a framework's versions: a price of the same supplier is superseded by the next higher one; lineage of one supplier's dearest."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    version = F.concat(F.lit("v"), F.year("l_shipdate").cast("string"))
    each = lines.groupBy(F.col("s_name").alias("framework_code"), version.alias("version_label")).agg(F.count("*").alias("n"))
    newest = each.groupBy("framework_code").agg(F.max("version_label").alias("newest"))
    versions = each.join(newest, "framework_code").select("framework_code", "version_label", (F.col("version_label") == F.col("newest")).alias("is_current"), F.concat(F.col("n").cast("string"), F.lit(" lines")).alias("edition_note"))
    year = F.substring("version_label", 2, 4).cast("int")
    relations = versions.select(F.col("framework_code").alias("from_framework_code"), F.col("version_label").alias("from_version_label"), F.col("framework_code").alias("to_framework_code"), F.concat(F.lit("v"), (year - 1).cast("string")).alias("to_version_label"), F.lit("supersedes").alias("relation_type"), F.concat(F.lit("one year after, with "), "edition_note").alias("note"))
    return tree.lineage(relations, versions, "Supplier#000000003", "v1996")


def prefix_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lines of nations: known prefixes to frameworks, unknown ones counted."""
    lines = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("from_id"), F.concat(F.lit("ISO/IEC 27001: 2022: Annex A Controls: 5."), F.col("n_nationkey").cast("string"), F.lit("\nCIS: 4.1\nOTHER: x")).alias("text"))
    sources = spark.createDataFrame([("ISO/IEC 27001", "iso27001", "N", True), ("CIS", "ciscontrols", None, True), ("OTHER", "none", None, False)], "prefix string, to_framework_code string, to_version_label string, enabled boolean")
    found = mapping.prefix_references(lines, sources)
    norm = F.when(F.col("to_framework_code") == "iso27001", iso_reference(F.col("rest"))).otherwise(F.col("rest"))
    return found.select("from_id", "prefix", "to_framework_code", norm.alias("to_citation_norm"))


def skip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' reference lines under their brands, of which the lower half is known: how many became edges, and what was left out, counted as the edges are written."""
    part = read(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    good = F.concat("p_brand", F.lit(" : 2022: Annex A Controls: 5."), size)
    lines = part.select(k.alias("from_id"), F.concat_ws("\n", F.when(k % 3 == 0, good).when(k % 3 == 1, F.concat("p_brand", F.lit(": None"))).otherwise(F.col("p_name")), F.lit("  "), F.when(k % 5 == 0, F.concat("p_brand", F.lit(":"), F.lit("2022: Mandatory Clause: 4."), size))).alias("text"))
    brands = part.select("p_brand").distinct()
    sources = brands.filter("p_brand < 'Brand#3'").select(F.col("p_brand").alias("prefix"), F.lit("iso27001").alias("to_framework_code"), F.lit("2022").alias("to_version_label"), (F.col("p_brand") != "Brand#12").alias("enabled"))
    found, seen = mapping.counted_references(lines, sources, lambda prefix, rest: iso_reference(rest))
    held = durable(found, "edges")
    counts = seen.get
    totals = held.agg(F.count("*").alias("written"), F.count_distinct("to_citation_norm").alias("norms"))
    return totals.select(*[F.lit(counts[c]).cast("long").alias(c) for c in ("lines", "no_prefix", "unknown_prefix", "skipped", "edges")], F.lit(sum(v for c, v in counts.items() if c.startswith("skipped:"))).cast("long").alias("skipped_by_prefix"), "written", "norms")


def crosswalks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of crosswalk workbooks, a brand's each, of three sheets; nations are the focal controls. Edges, with how many pairs had no control."""
    k, text = F.col("p_partkey"), lambda c: F.lpad((c).cast("string"), 2, "0")
    focal = F.when(k % 11 == 0, "Focal element").otherwise(F.concat(F.lit(" AC-"), text(k % 30 + 1), F.when(k % 4 == 0, F.concat(F.lit("("), text(k % 3 + 1), F.lit(")"))).otherwise("")))
    target = F.when(k % 13 == 0, F.col("p_name")).otherwise(F.concat(F.when(k % 2 == 0, "A.").otherwise(""), (F.col("p_size") % 8 + 1).cast("string"), F.lit("."), (k % 5).cast("string")))
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_key"), (F.col("p_size") % 3).alias("sheet_no"), k.alias("k"), focal.alias("focal"), target.alias("target"))
    sheet = F.when(F.col("sheet_no") == 0, "Relationships").when(F.col("sheet_no") == 1, "Definitions").otherwise("More")
    cell = lambda letter, c: F.struct(F.concat(F.lit(letter), F.col("k").cast("string")).alias("ref"), F.col(c).alias("value"))
    cells = part.select("doc_key", "sheet_no", sheet.alias("sheet"), F.inline(F.array(cell("A", "focal"), cell("D", "target"))))
    nation = read(spark, sf_dir, "nation")
    held = nation.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") % 2).cast("long").alias("document_id"), F.concat(F.lit("AC-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.when(F.col("n_nationkey") % 4 == 3, "(01)").otherwise("")).alias("citation_norm"))
    docs = spark.createDataFrame([(0, "nist80053", "r5", "main"), (1, "nist80053", "r4", "main")], "id long, framework_code string, version_label string, doc_role string")
    versions = spark.createDataFrame([("nist80053", "r5", True), ("nist80053", "r4", False)], "framework_code string, version_label string, is_current boolean")
    edges, seen = mapping.crosswalk(workbooks.crosswalk_edges(cells), held, docs, versions, "nist80053", "iso27001", "2022", "olir")
    found = durable(edges, "edges")
    counts = seen.get
    return found.groupBy("from_control_id").agg(F.count("*").alias("edges"), F.min("to_citation_norm").alias("least"), F.max("provenance_detail").alias("provenance")).withColumns({c: F.lit(counts[c]).cast("long") for c in ("pairs", "unknown_focal")})


def dealt_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as controls of their customer's document, their lines below them: ids without gaps and parents by id."""
    order = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"))
    norm = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct().join(order, "o_orderkey")
    top = order.select("document_id", (F.col("o_orderkey") * 100).alias("ordinal"), norm.alias("citation_norm"), F.lit(None).cast("string").alias("parent_norm"))
    below = line.select("document_id", (F.col("o_orderkey") * 100 + 1 + F.col("l_linenumber")).alias("ordinal"), F.concat(norm, F.lit("."), F.col("l_linenumber").cast("string")).alias("citation_norm"), norm.alias("parent_norm"))
    return numbering.with_ids(top.unionByName(below), 1001).select("id", "document_id", "citation_norm", "parent_control_id")


def published_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as controls and orders as edges, published together; a nation rebuilt is the second version, and a rebuild that fails is none. Rows of both versions."""
    store = Published(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")
    held = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("document_id"), "c_acctbal")
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_control_id"), (F.col("o_custkey") % 97 + 1).alias("to_control_id"))
    store.replace({"controls": held, "edges": links})
    new = held.filter("document_id = 7 and c_acctbal > 0").withColumn("id", F.col("id") + 1_000_000)
    controls, edges = mapping.rebuild_controls(store.read("controls"), store.read("edges"), new)
    store.replace({"controls": controls, "edges": edges}, after=1)
    broken = new.withColumn("id", F.when(F.col("id") > 0, F.raise_error(F.lit("no such page")).cast("long")))
    try:
        store.replace({"edges": links.limit(0), "controls": broken}, after=2)
    except PySparkException:
        pass  # what the query shows: the version is still the second
    each = []
    for version in store.versions():
        open_ = F.when(F.col("to_control_id").isNull(), "open edges").otherwise("edges")
        each.append(store.read("controls", version).agg(F.count("*").alias("rows"), F.sum("id").alias("ids")).select(F.lit("controls").alias("table"), "rows", "ids", F.lit(version).alias("version")))
        each.append(store.read("edges", version).groupBy(open_.alias("table")).agg(F.count("*").alias("rows"), F.sum("from_control_id").alias("ids")).withColumn("version", F.lit(version)))
    return functools.reduce(DataFrame.unionByName, each)


def title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their type's key against titles written otherwise."""
    parts = read(spark, sf_dir, "part").select("p_partkey", title_key(F.col("p_type")).alias("key"))
    titles = read(spark, sf_dir, "part").select(F.concat(F.lit("  "), F.replace(F.upper("p_type"), F.lit(" "), F.lit("   "))).alias("title")).distinct().select(title_key(F.col("title")).alias("key"), "title")
    return parts.join(titles, "key").select("p_partkey", "key", "title")


def iso_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and targets of every form that the parsers tell apart, with a nation's number in them."""
    k = F.col("n_nationkey").cast("string")
    forms = ["2022: Annex A Controls: 5.@", "2022: Annex A Controls: 5.@,", "2022: Mandatory Clause: 4.@", "2022: Control 5.@", "2022: Mandatory Clause: None", "2022: Annex A Controls:", "2022: Annex A Controls: 5.@, 5.1", "2013: Annex A Controls: 5.@", "2022: Something 5.@", "A5.@", "A.5.@", "7.@", "7.@.1", "@", "ac-@", "AC-2(@)", "pr.aa-0@", "x"]
    each = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*[F.replace(F.lit(f), F.lit("@"), k) for f in forms])).alias("text"))
    return each.select("n_nationkey", "text", iso_reference(F.col("text")).alias("reference"), iso_target(F.col("text")).alias("iso"), sp80053_target(F.col("text")).alias("sp80053"), csf_target(F.col("text")).alias("csf"))


def deduped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for an order, a version, which may be null, and a number, with the sources that say so."""
    line = read(spark, sf_dir, "lineitem")
    rows = line.select("l_orderkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("version"), (F.col("l_partkey") % 3).alias("norm"), F.concat(F.lit("source "), (F.col("l_suppkey") % 7).cast("string")).alias("source_name"))
    return mapping.dedupe_edges(rows, ["l_orderkey", "version", "norm"])


def norm_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines' numbers as controls of one framework's current main document; what it lacks stays null."""
    held, docs, versions, _ = controls(spark, sf_dir)
    asked = edges(spark, sf_dir).select(F.col("from_control_id"), F.col("to_citation_norm").alias("citation_norm")).distinct()
    found = mapping.norms_to_ids(asked, held, docs, versions, "iso27001")
    return found.groupBy("control_id").agg(F.count("*").alias("edges"))


def tree_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region as parent, and the first children of one of them."""
    region = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("citation"), F.col("r_name").alias("title"), F.lit(0).alias("ordinal"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 100).cast("long").alias("parent_id"), F.col("n_name").alias("citation"), F.col("n_name").alias("title"), (F.lit(0) - F.col("n_nationkey")).cast("int").alias("ordinal"))
    every = region.unionAll(nation)
    up = tree.parents(every).select("id", "citation", "parent_citation", F.lit("parent").alias("walk"))
    down = tree.children(every, F.lit(102), 3).select("id", "citation", F.lit(None).cast("string").alias("parent_citation"), F.lit("child").alias("walk"))
    return up.unionByName(down)


def ancestor_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region over nation over customer; a customer's context prefix from its ancestors."""
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("citation"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("citation"))
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.col("c_name").alias("citation"))
    every = region.unionAll(nation).unionAll(customer)
    return tree.ancestors(every).select("id", F.array_join("path", " > ").alias("path"))


def dotted_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.lit("8"), F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")).alias("citation"))
    return cites.select("p_partkey", dotted_parent(F.col("citation")).alias("parent"), category_parent(F.concat(F.lit("PR.AA-"), F.col("p_partkey").cast("string"))).alias("category"), F.array_join(dotted_order(F.col("citation")), ".").alias("sort_key"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation: each user turn opens a section and is the parent of what follows."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    user = F.col("role") == "user"
    held = tree.carry_header(tree.sections(turns, "conv_id", "turn", user), "conv_id", "turn", user, F.col("turn"), "parent_turn")
    return tree.first_sighting(held, ["conv_id", "section"], ["turn"]).select("conv_id", "section", "parent_turn", F.col("turn").alias("first_turn"))


def pick_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, docs, versions, _ = controls(spark, sf_dir)
    found = tree.pick_control(held, docs, versions, F.lit("16.8"), F.lit("16.08"))
    return found.select("id", "framework_code", "version_label", "citation_norm")


def amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders amend open ones of the same customer, by total price in whole thousands."""
    orders = read(spark, sf_dir, "orders")
    held = orders.filter("o_orderstatus = 'F'").select(F.lit(9).alias("document_id"), F.col("o_orderkey").cast("string").alias("citation"), F.floor(F.col("o_totalprice") / 1000).cast("string").alias("amends_citation_norm"), F.lit("replace").alias("amend_action"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("body"))
    docs = spark.createDataFrame([(9, "iso27001", "N", "amendment", "amd1", "iso27001|N|amendment:amd1"), (8, "iso27001", "N", "main", "", "iso27001|N|main")], "id int, framework_code string, version_label string, doc_role string, qualifier string, doc_key string")
    return tree.amendments(held, docs, "iso27001", "N", "150")


_C = f"""controls as (select p_partkey as id, p_partkey % 4 + 1 as document_id, case when p_partkey % 3 = 0 and p_size % 5 = 0 then 'A.' else '' end || p_size || '.' || p_partkey % 40 as citation_norm,
        case when p_partkey % 3 = 0 and p_size % 5 = 0 then 'annex-control' else 'clause' end as kind, p_name as citation from part where p_size <= {LOADED}),
    docs(document_id, framework_code, version_label) as (values (1, 'iso27001', 'N'), (2, 'iso27001', 'R'), (3, 'ciscontrols', 'N'), (4, 'ciscontrols', 'R')),
    targets as (select framework_code, version_label, citation_norm, arg_min(kind, id) as kind, min(id) as id from controls join docs using (document_id) group by 1, 2, 3)"""
_E = """edges as (select distinct l_orderkey as from_control_id, case when l_suppkey % 2 = 0 then 'iso27001' else 'ciscontrols' end as to_framework_code, case when l_returnflag <> 'N' then l_returnflag end as to_version_label,
        (l_partkey % 50 + 1) || '.' || l_partkey % 40 as to_citation_norm, l_linestatus as mapping_source_code, 'row' as provenance_detail from lineitem)"""
_R = f"""{_C}, {_E}, placed as (select *, coalesce(to_version_label, 'N') as v from edges),
    annexed as (select t.version_label, substr(citation_norm, 3) as norm, min(id) as id from targets t where framework_code = 'iso27001' and kind = 'annex-control' and citation_norm like 'A.%'
        and not exists (select 1 from targets c where c.framework_code = 'iso27001' and c.kind = 'clause' and c.version_label = t.version_label and c.citation_norm = substr(t.citation_norm, 3)) group by 1, 2),
    hops as (select 'ciscontrols' as f, 'A' as old, citation_norm, id from targets where framework_code = 'ciscontrols' and version_label = 'N'),
    tried as (select e.*, s.id as standard, case when e.to_framework_code = 'iso27001' then a.id end as annex, h.id as successor from placed e
        left join targets s on s.framework_code = e.to_framework_code and s.version_label = e.v and s.citation_norm = e.to_citation_norm
        left join annexed a on a.version_label = e.v and a.norm = e.to_citation_norm
        left join hops h on h.f = e.to_framework_code and h.old = e.to_version_label and h.citation_norm = e.to_citation_norm),
    resolved as materialized (select from_control_id, to_framework_code, to_version_label, to_citation_norm, mapping_source_code, coalesce(standard, annex, successor) as to_control_id,
        case when standard is not null then 'standard' when annex is not null then 'annex-prefix' when successor is not null then 'supersession' end as resolved_by,
        case when standard is not null then provenance_detail when annex is not null then provenance_detail || '; annex-prefix: resolved ' || to_citation_norm || ' as A.' || to_citation_norm
            when successor is not null then provenance_detail || '; version-supersession: cited ' || to_version_label || ' resolved in successor N' else provenance_detail end as provenance_detail from tried)"""
_KEYS = "from_control_id, to_framework_code, to_version_label, to_citation_norm, mapping_source_code"

QUERIES = {f.__name__: f for f in (resolve_edges, resolve_annex, resolve_supersession, resolve_all, unresolved_groups, dossiers, outbound_edges, inbound_edges, structural_edges, longest_equivalent, version_lineage, prefix_refs, skip_counters, crosswalks, dealt_controls, published_rebuild, iso_forms, deduped_edges, norm_lookup, tree_walks, title_join, ancestor_path, dotted_parents, sections, pick_control, amendments)}
ORACLES = {
    "resolve_edges": f"with {_C}, {_E} select {_KEYS}, t.id as to_control_id from edges e left join targets t on t.framework_code = e.to_framework_code and t.version_label = coalesce(e.to_version_label, 'N') and t.citation_norm = e.to_citation_norm",
    "resolve_annex": f"with {_R} select {_KEYS}, to_control_id, provenance_detail from resolved where resolved_by = 'annex-prefix'",
    "resolve_supersession": f"with {_R} select {_KEYS}, to_control_id, provenance_detail from resolved where resolved_by = 'supersession'",
    "resolve_all": f"with {_R} select to_framework_code, coalesce(resolved_by, 'open') as resolved_by, count(*) as edges, count(distinct to_control_id) as targets from resolved group by 1, 2",
    "unresolved_groups": f"with {_R} select to_framework_code, coalesce(to_version_label, '') as to_version_label, to_citation_norm, mapping_source_code, count(*) as edges, string_agg(distinct lower(c_mktsegment), ', ' order by lower(c_mktsegment)) as from_frameworks from resolved join orders on o_orderkey = from_control_id join customer on c_custkey = o_custkey and c_acctbal > 0 where to_control_id is null group by resolved.to_framework_code, resolved.to_version_label, resolved.to_citation_norm, resolved.mapping_source_code order by edges desc, to_framework_code, to_citation_norm, coalesce(to_version_label, ''), mapping_source_code limit 50",
    "dossiers": f"""with {_R}, v(framework_code, version_label, is_current) as (values ('iso27001', 'N', true), ('iso27001', 'R', false), ('ciscontrols', 'N', true), ('ciscontrols', 'R', false)),
        q as (select n_nationkey as q, n_nationkey % 11 + 1 || '.' || n_nationkey * 7 % 40 as norm, case when n_nationkey % 3 = 1 then 'iso27001' when n_nationkey % 6 = 2 then 'none' else '' end as f, case when n_nationkey % 4 = 3 then 'R' else '' end as v from nation),
        bear as (select q.*, c.id, d.framework_code, d.version_label, v.is_current from q join controls c on c.citation_norm = q.norm join docs d using (document_id) join v on v.framework_code = d.framework_code and v.version_label = d.version_label),
        pick as (select * from bear where (f = '' or framework_code = f) and case when v <> '' then version_label = v else is_current end qualify row_number() over (partition by q order by is_current desc, framework_code, id) = 1),
        oth as (select b.q, string_agg(distinct b.framework_code, '/' order by b.framework_code) as o from bear b left join pick p using (q) where b.is_current and b.framework_code <> coalesce(p.framework_code, b.f) group by 1),
        ver as (select q, string_agg(distinct framework_code || ' ' || version_label, '/' order by framework_code || ' ' || version_label) as o from bear where f = '' or framework_code = f group by 1),
        kid as (select p.q, string_agg(k.id, ',' order by k.id % 5, k.id) as ids from pick p join controls k on k.id // 20 = p.id group by 1),
        outb as (select p.q, count(*) as n, string_agg(to_framework_code || '|' || to_citation_norm || '|' || coalesce(t.citation, ''), ',' order by to_framework_code, to_citation_norm, to_version_label nulls first, mapping_source_code) as e from pick p join resolved on from_control_id = p.id left join controls t on t.id = to_control_id group by 1),
        inb as (select p.q, count(*) as n from pick p join resolved r on r.to_control_id = p.id join controls s on s.id = r.from_control_id group by 1),
        lin as (select q, string_agg(line, ',' order by b, kind, f, ver) as line from (select q, 0 as b, 'from' as kind, framework_code as f, case framework_code when 'iso27001' then 'R' else 'A' end as ver, 'from ' || case framework_code when 'iso27001' then 'R amends' else 'A supersedes' end as line from pick where version_label = 'N'
            union all select q, 0, 'to', framework_code, 'N', 'to N amends' from pick where framework_code = 'iso27001' and version_label = 'R' union all select q, 1, 'version', p.framework_code, v.version_label, 'version ' || v.version_label || ' ' from pick p join v on v.framework_code = p.framework_code) group by 1),
        chk as (select p.q, count(*) as n, string_agg(doc_id, ',' order by doc_id) filter (r <= 20) as ids from (select p.q, doc_id, row_number() over (partition by p.q order by doc_id) as r from pick p join documents on doc_id % 300 = p.id) p group by 1)
        select q.q as query_id, p.id is not null as found, p.id as control_id, p.framework_code, p.version_label, concat_ws(',', case when p.id is null then 'no_evidence' end, case when p.id is null and q.v <> '' and ver.o is not null then 'version_not_found:' || ver.o end, case when p.id is null and q.f <> '' and oth.o is not null then 'found_elsewhere:' || oth.o end, case when p.id is not null and q.f = '' and oth.o is not null then 'ambiguous_citation:' || oth.o end, case when p.id is not null and chk.n is null then 'no_chunks' end) as gaps,
            kid.ids as children, coalesce(outb.n, 0) as n_outbound, outb.e as outbound, coalesce(inb.n, 0) as n_inbound, lin.line as lineage, chk.ids as chunks, coalesce(chk.n, 0) as n_chunks, coalesce(chk.n, 0) > 20 as more_chunks
        from q left join pick p using (q) left join oth using (q) left join ver using (q) left join kid using (q) left join outb using (q) left join inb using (q) left join lin using (q) left join chk using (q)""",
    "outbound_edges": f"with {_R} select {_KEYS}, to_control_id, coalesce(c.citation, '') as resolved_title, to_control_id is not null as resolved from resolved left join controls c on c.id = to_control_id",
    "inbound_edges": f"with {_R} select to_control_id, o_orderpriority as from_citation, count(*) as edges from resolved join orders on o_orderkey = from_control_id where to_control_id is not null group by 1, 2",
    "structural_edges": f"with {_C}, both_ways as (select a.id as a, b.id as b, a.citation_norm as an, b.citation_norm as bn from controls a join controls b on b.citation_norm = substr(a.citation_norm, 3) where a.citation_norm like 'A.%' and b.citation_norm not like 'A.%') select a as from_id, bn as to_norm, 'equivalent' as relationship from both_ways union all select b, an, 'equivalent' from both_ways",
    "longest_equivalent": "with p as (select f.doc_id as from_id, t.doc_id as to_id, length(t.text) as n from documents f join documents t on t.doc_id in (f.doc_id + 20, f.doc_id + 40, f.doc_id + 60) where length(t.text) > coalesce(length(f.text), 0)) select from_id, to_id, n as length from p qualify row_number() over (partition by from_id order by n desc, to_id) = 1",
    "version_lineage": "with v as (select s_name as f, 'v' || year(l_shipdate) as v, year(l_shipdate) as y, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey where s_name = 'Supplier#000000003' group by 1, 2, 3), c as (select *, y = max(y) over () as cur from v) select 0 as block, 'from' as kind, f as framework_code, 'v1995' as version_label, 'supersedes' as relation_type, coalesce((select cur from c where y = 1995), false) as is_current, 'one year after, with ' || n || ' lines' as note from c where y = 1996 union all select 0, 'to', f, 'v1997', 'supersedes', cur, 'one year after, with ' || n || ' lines' from c where y = 1997 union all select 1, 'version', f, v, '', cur, n || ' lines' from c",
    "prefix_refs": "select n_nationkey as from_id, 'ISO/IEC 27001' as prefix, 'iso27001' as to_framework_code, 'A.5.' || n_nationkey as to_citation_norm from nation union all select n_nationkey, 'CIS', 'ciscontrols', '4.1' from nation union all select n_nationkey, 'OTHER', null, 'x' from nation",
    "skip_counters": "with p as (select p_partkey as k, p_size as size, p_brand as b, p_brand < 'Brand#3' and p_brand <> 'Brand#12' as known from part), l as (select b, known, case when k % 3 = 0 then 'A.5.' || size end as norm, k % 3 = 2 as bare from p union all select b, known, '4.' || size, false from p where k % 5 = 0) select count(*) as lines, count(*) filter (bare) as no_prefix, count(*) filter (not bare and not known) as unknown_prefix, count(*) filter (not bare and known and norm is null) as skipped, count(*) filter (not bare and known and norm is not null) as edges, count(*) filter (not bare and known and norm is null) as skipped_by_prefix, count(*) filter (not bare and known and norm is not null) as written, count(distinct norm) filter (not bare and known) as norms from l",
    "crosswalks": r"with c as (select p_brand as d, p_size % 3 as no, case p_size % 3 when 0 then 'Relationships' when 1 then 'Definitions' else 'More' end as sheet, p_partkey as k, case when p_partkey % 11 = 0 then 'Focal element' else 'AC-' || lpad((p_partkey % 30 + 1)::varchar, 2, '0') || case when p_partkey % 4 = 0 then '(' || lpad((p_partkey % 3 + 1)::varchar, 2, '0') || ')' else '' end end as f, case when p_partkey % 13 = 0 then p_name else case when p_partkey % 2 = 0 then 'A.' else '' end || (p_size % 8 + 1) || '.' || p_partkey % 5 end as t from part), p as (select d, f, t, 'sheet ' || arg_min(sheet, no * 100000000 + k) || ' row ' || arg_min(k, no * 100000000 + k) as prov from c where sheet <> 'Definitions' and regexp_full_match(f, '[A-Z]{2}-\d{2}(\(\d{2}\))?') and regexp_full_match(t, '(A\.)?\d+(\.\d+)*') group by 1, 2, 3), n as (select n_nationkey as id, 'AC-' || lpad((n_nationkey + 1)::varchar, 2, '0') || case when n_nationkey % 4 = 3 then '(01)' else '' end as f from nation where n_regionkey % 2 = 0) select id::bigint as from_control_id, count(*) as edges, min(t) as least, max(prov) as provenance, (select count(*) from p) as pairs, (select count(*) from p where f not in (select f from n)) as unknown_focal from p join n using (f) group by 1",
    "dealt_controls": "with l as (select distinct l_orderkey as k, l_linenumber as n from lineitem), c as (select o_custkey as document_id, o_orderkey * 100 as ordinal, 'O' || o_orderkey as citation_norm, null as parent_norm from orders union all select o_custkey, k * 100 + 1 + n, 'O' || k || '.' || n, 'O' || k from l join orders on o_orderkey = k), i as (select *, 1000 + row_number() over (order by document_id, ordinal, citation_norm) as id from c) select i.id, i.document_id, i.citation_norm, p.id as parent_control_id from i left join i p on p.document_id = i.document_id and p.citation_norm = i.parent_norm",
    "published_rebuild": "with gone as (select c_custkey as id from customer where c_nationkey = 7), e as (select o_custkey as f, o_custkey % 97 + 1 as t from orders), kept as (select c_custkey as id from customer where c_nationkey <> 7 union all select c_custkey + 1000000 from customer where c_nationkey = 7 and c_acctbal > 0) select 'controls' as table, count(*) as rows, sum(c_custkey)::bigint as ids, 1 as version from customer union all select 'edges', count(*), sum(f)::bigint, 1 from e union all select 'controls', count(*), sum(id)::bigint, 2 from kept union all select case when t in (from gone) then 'open edges' else 'edges' end, count(*), sum(f)::bigint, 2 from e where f not in (from gone) group by 1",
    "iso_forms": r"""with f(form) as (values ('2022: Annex A Controls: 5.@'), ('2022: Annex A Controls: 5.@,'), ('2022: Mandatory Clause: 4.@'), ('2022: Control 5.@'), ('2022: Mandatory Clause: None'), ('2022: Annex A Controls:'), ('2022: Annex A Controls: 5.@, 5.1'), ('2013: Annex A Controls: 5.@'), ('2022: Something 5.@'), ('A5.@'), ('A.5.@'), ('7.@'), ('7.@.1'), ('@'), ('ac-@'), ('AC-2(@)'), ('pr.aa-0@'), ('x')),
        t as (select n_nationkey, form, n_nationkey::varchar as k, replace(form, '@', n_nationkey::varchar) as text from nation, f)
        select n_nationkey, text, case when form in ('2022: Annex A Controls: 5.@', '2022: Annex A Controls: 5.@,', '2022: Control 5.@') then 'A.5.' || k when form = '2022: Mandatory Clause: 4.@' then '4.' || k end as reference,
            case when form = 'A5.@' then 'A.5.' || k when form in ('7.@', '7.@.1', '@') then text end as iso, case when form = 'ac-@' then 'AC-' || lpad(k, 2, '0') when form = 'AC-2(@)' then 'AC-02(' || lpad(k, 2, '0') || ')' end as sp80053,
            case when form = 'pr.aa-0@' and n_nationkey < 10 then 'PR.AA-0' || k end as csf from t""",
    "deduped_edges": "select l_orderkey, case when l_returnflag <> 'N' then l_returnflag end as version, l_partkey % 3 as norm, string_agg(distinct 'source ' || l_suppkey % 7, '; ' order by 'source ' || l_suppkey % 7) as sources from lineitem group by 1, 2, 3",
    "norm_lookup": f"with {_C}, {_E}, a as (select distinct from_control_id, to_citation_norm as norm from edges), i as (select citation_norm as norm, max(id) as control_id from controls join docs using (document_id) where framework_code = 'iso27001' and version_label = 'N' group by 1) select control_id, count(*) as edges from a left join i using (norm) group by 1",
    "tree_walks": "with e as (select r_regionkey + 100 as id, null as parent_id, r_name as citation, 0 as ordinal from region union all select n_nationkey, n_regionkey + 100, n_name, -n_nationkey from nation), d as (select id, citation from e where parent_id = 102 order by ordinal, id limit 3) select e.id::bigint as id, e.citation, p.citation as parent_citation, 'parent' as walk from e left join e p on p.id = e.parent_id union all select id::bigint, citation, null, 'child' from d",
    "title_join": "with t as (select distinct '  ' || replace(upper(p_type), ' ', '   ') as title from part) select p_partkey, lower(regexp_replace(trim(p_type), '\\s+', ' ', 'g')) as key, title from part join t on lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) = lower(regexp_replace(trim(p_type), '\\s+', ' ', 'g'))",
    "ancestor_path": "select 'r' || r_regionkey as id, '' as path from region union all select 'n' || n_nationkey, r_name from nation join region on r_regionkey = n_regionkey union all select 'c' || c_custkey, r_name || ' > ' || n_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey",
    "dotted_parents": "select p_partkey, '8.' || p_size as parent, 'PR.AA' as category, '00000008.' || lpad(p_size::varchar, 8, '0') || '.' || lpad((p_partkey % 7)::varchar, 8, '0') as sort_key from part",
    "sections": "with s as (select *, (sum((role = 'user')::int) over w)::bigint as section, last_value(case when role = 'user' then turn end ignore nulls) over w as parent_turn from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)) select conv_id, section, parent_turn, turn as first_turn from s qualify row_number() over (partition by conv_id, section order by turn) = 1",
    "pick_control": f"with {_C} select id, framework_code, version_label, citation_norm from controls join docs using (document_id) where citation_norm in ('16.8', '16.08') and version_label = 'N' order by framework_code, citation_norm, id limit 1",
    "amendments": "select o_orderkey::varchar as citation, 'replace' as action, 'amd1' as qualifier, 'iso27001|N|amendment:amd1' as doc_key, o_orderpriority as title, '' as body from orders where o_orderstatus = 'F' and floor(o_totalprice / 1000) = 150",
}
