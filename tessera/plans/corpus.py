"""Corpus status, state transitions and evaluation over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import durable, shared_dir
from tessera.functions.citations import cell_column, cell_row
from tessera.functions.text import chunk_content, context_prefix, labelled_body
from tessera.operators import embedding, evaluation, lexical, mapping, numbering, retrieval, state, status
from tessera.operators.embedding import build_chunks
from tessera.operators.lexical_many import Arm
from tessera.plans.tables import CHUNKS, COSINE, TOKENS, chunk_keys, chunks, lexical_index, read, texts
from tessera.published import Published
from tessera.sources import iso


def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages as versions, documents as controls, vectors as embeddings, orders as edges between documents."""
    keys = chunk_keys(spark, sf_dir)
    docs = keys.select("framework_code", "version_label").distinct().withColumn("id", F.concat_ws("|", "framework_code", "version_label"))
    versions = docs.drop("id")
    controls = keys.select(F.col("chunk_id").alias("id"), F.concat_ws("|", "framework_code", "version_label").alias("document_id"), "status")
    chunk = keys.filter("status = 'active'").select(F.col("chunk_id").alias("id"), F.col("chunk_id").alias("control_id"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    links = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("from_control_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("to_control_id"))
    return status.status_rows(versions, docs, controls, chunk, vectors, links)


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.totals(corpus_status(spark, sf_dir))


def framework_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = status.framework_versions(chunk_keys(spark, sf_dir).select("framework_code", "version_label"))
    return found.select("framework_code", F.array_join("versions", ",").alias("versions"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: the priority says what is known, the status how far it got."""
    o = read(spark, sf_dir, "orders")
    role = F.when(F.col("o_orderkey") % 7 == 0, "amendment").when(F.col("o_orderkey") % 7 == 1, "guide").when(F.col("o_orderkey") % 7 == 2, "companion-workbook").when(F.col("o_orderkey") % 7 != 3, "main")
    done = F.col("o_orderdate")
    return o.select(
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("rel_path"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("sha256"),
        F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority")).alias("framework_code"), F.col("o_orderstatus").alias("version_label"), role.alias("doc_role"), F.lit("").alias("qualifier"),
        F.col("o_orderpriority").startswith("4").alias("ignored"), F.when(F.col("o_orderkey") % 50 == 9, "bad magic").alias("stage_error"), F.when(F.col("o_orderkey") % 11 == 5, "removed").otherwise("active").alias("status"),
        F.when(F.col("o_orderstatus") != "O", done).alias("extracted_at"), F.when(F.col("o_orderstatus") == "F", done).alias("normalized_at"), F.lit(None).cast("timestamp").alias("indexed_at"))


def stage_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _manifest(spark, sf_dir)
    parts = [state.eligible(held, s).select("rel_path", F.lit(s).alias("stage")) for s in state.STAGES]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def deferred_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _manifest(spark, sf_dir)
    have = held.filter("framework_code = '1-URGENT' or version_label = 'P'").select("framework_code", "version_label", "doc_role", "qualifier").distinct()
    return status.deferred_documents(held, have).groupBy("framework_code", "version_label", "doc_role", "reason").agg(F.count("*").alias("files"))


def manifest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.manifest_gaps(_manifest(spark, sf_dir))


def manifest_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _manifest(spark, sf_dir)
    each = [status.listing(held, kind).select(F.lit(kind).alias("listing"), "rel_path") for kind in status.LISTINGS]
    return each[0].unionAll(each[1]).unionAll(each[2])


def registry_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as frameworks, nations as their versions, suppliers as sources of references, parts as controls of a document: each listing with its rows' places."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("framework_code"), F.col("n_name").alias("version_label"), (F.col("n_nationkey") % 5 == 1).alias("is_current"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("prefix"), (F.col("s_acctbal") > 0).alias("enabled"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("ordinal"), F.col("p_brand").alias("document_id"), "p_name")
    region = read(spark, sf_dir, "region").select(F.lower("r_name").alias("code"))
    each = {
        "frameworks": (status.listed("frameworks", region), F.col("code")), "versions": (status.listed("versions", nation), F.concat_ws(" ", "framework_code", "version_label")), "current_versions": (status.listed("current_versions", nation), F.concat_ws(" ", "framework_code", "version_label")),
        "reference_sources": (status.listed("reference_sources", supplier), F.col("prefix")), "controls": (status.listed("controls", part, document_id="Brand#1"), F.col("p_name")),
    }
    found = None
    for kind, (rows, name) in each.items():
        _, order = status.REGISTRY[kind]
        own = numbering.dealt(rows.withColumn("name", name), [*order, "name"], "place").select(F.lit(kind).alias("listing"), "place", "name")
        found = own if found is None else found.unionByName(own)
    return found


def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document by its key and a file by its path; a version without a label by null."""
    held = _manifest(spark, sf_dir)
    by_path = status.lookup(held, rel_path="orders/7.pdf").select(F.lit("path").alias("by"), "rel_path", "sha256")
    by_two = status.lookup(held, framework_code=None, version_label="P").select(F.lit("unknown framework").alias("by"), "rel_path", "sha256")
    return by_path.unionAll(by_two)


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan: a tenth of the files changed, a tenth gone, some new."""
    old = _manifest(spark, sf_dir)
    key = F.regexp_extract("rel_path", r"(\d+)", 1).cast("long")
    scan = old.filter(key % 10 != 3).select("rel_path", F.when(key % 10 == 4, F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256")).alias("sha256"))
    new = read(spark, sf_dir, "nation").select(F.concat(F.lit("new/"), F.col("n_name")).alias("rel_path"), F.lit("n").alias("sha256"))
    found = state.upsert_manifest(old, scan.unionByName(new))
    return found.select("rel_path", "sha256", "status", F.col("extracted_at").isNotNull().alias("extracted"), F.col("normalized_at").isNotNull().alias("normalized"))


def stage_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _manifest(spark, sf_dir)
    found = state.mark(held, held.filter("version_label = 'P'"), "normalized_at", F.lit("2024-01-01").cast("timestamp"))
    return found.groupBy("version_label", F.coalesce(F.col("normalized_at").cast("date").cast("string"), F.lit("-")).alias("normalized"), F.col("stage_error").isNotNull().alias("failed")).agg(F.count("*").alias("files"))


def reseed_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    user = seed.filter("n_nationkey % 4 = 1").select((F.col("n_nationkey") + 20).cast("int").alias("n_nationkey"), F.lower("n_name").alias("n_name"))
    return state.overlay(seed, user, ["n_nationkey"])


def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return state.ambiguous(lines, ["l_orderkey", "l_linenumber"]).groupBy("is_ambiguous").agg(F.count("*").alias("rows"), F.sum("l_partkey").alias("parts"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 2).alias("control_id"))
    keep, gone = state.orphans(chunk, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
    return keep.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model"))
    return state.missing_embeddings(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), have, "model-1")


def latest_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


def source_url_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.tree import source_urls

    pages = read(spark, sf_dir, "pages").select((F.col("page_id") % 60).cast("string").alias("sha256"), F.when(F.col("page_id") % 60 < 50, F.col("url")).otherwise("").alias("source_url"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 70).cast("string").alias("source_file_sha256"))
    return source_urls(docs, pages)


#: Globs over urls, in order, a bad one and one with two stars among them, and the same as patterns of DuckDB.
RULES = [("https://[a-m]*.com/en/*", "a-m.com"), ("[https://*", "bad"), ("http*://*/[^a-df-z]n/**", "en"), ("h?tps://*/de/*", "de"), ("https://*/es/[0-4]*", "es-low"), ("*//*/*/*", "any")]
LIKE = ["https://[a-m][^/]*\\.com/en/[^/]*", None, "http[^/]*://[^/]*/[^a-df-z]n/[^/]*", "h[^/]tps://[^/]*/de/[^/]*", "https://[^/]*/es/[0-4][^/]*", "[^/]*//[^/]*/[^/]*/[^/]*"]


def glob_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"pattern": p, "ordinal": k, "identity": name} for k, (p, name) in enumerate(RULES)]
    return state.match_rules(read(spark, sf_dir, "pages").select("page_id", "url"), rules, "url").select("page_id", "ordinal", "identity")


def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their key, a customer's order priority: later orders bring a title, a capture and a gate, while the row's id and what its key was made of stay."""
    o = read(spark, sf_dir, "orders").select(
        F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("doc_key"), F.col("o_orderkey").alias("id"), F.lower("o_orderpriority").alias("framework_code"), F.col("o_orderstatus").alias("version_label"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("source_file_sha256"), F.when(F.col("o_orderkey") % 3 == 0, "internal").otherwise("open").alias("serve_gate"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).alias("markdown"))
    old = o.filter("id % 2 = 0").groupBy("doc_key").agg(F.max_by(F.struct(*[c for c in o.columns if c != "doc_key"]), "id").alias("r")).select("doc_key", "r.*")
    new = o.filter("id % 2 = 1").withColumn("at", F.col("id"))
    return state.merge(old, new, list(mapping.DOCUMENT_KEY), mapping.DOCUMENT_REPLACED, order="at")


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by their key, of which a null version is a part; a later line changes relationship and provenance, a target once found stays."""
    line = read(spark, sf_dir, "lineitem")
    version = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    rows = line.select(F.col("l_orderkey").alias("from_control_id"), F.lit("iso27001").alias("to_framework_code"), version.alias("to_version_label"), (F.col("l_partkey") % 5).cast("string").alias("to_citation_norm"), F.col("l_linestatus").alias("mapping_source_code"),
        F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")).alias("relationship"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("provenance_detail"), F.col("l_partkey").alias("to_control_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"))
    first = state.latest(rows.filter("at.l_linenumber <= 2"), list(mapping.EDGE_KEY), "at").drop("at")
    found = state.merge(first, rows.filter("at.l_linenumber > 2").drop("to_control_id"), list(mapping.EDGE_KEY), mapping.EDGE_REPLACED, order="at")
    return found.groupBy("to_version_label", "mapping_source_code", "to_citation_norm", "relationship").agg(F.count("*").alias("edges"), F.sum(F.regexp_extract("provenance_detail", r"(\d+)", 1).cast("int")).alias("lines"), F.count("to_control_id").alias("resolved"), F.sum("to_control_id").alias("targets"))


def relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version relations: nations' own, of which one key has another note, and those that come with the program."""
    nation = read(spark, sf_dir, "nation")
    own = nation.select(F.lower("n_name").alias("from_framework_code"), F.lit("v2").alias("from_version_label"), F.lower("n_name").alias("to_framework_code"), F.lit("v1").alias("to_version_label"), F.lit("supersedes").alias("relation_type"), F.lit("old").alias("note"))
    new = own.filter("from_framework_code < 'g'").withColumn("note", F.lit("new")).unionByName(mapping.known_supersessions(spark))
    return state.merge(own, new, list(mapping.RELATION_KEY), mapping.RELATION_REPLACED)


def control_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as controls of their nation's document: one nation is rebuilt without its poorer ones, edges follow."""
    held = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("document_id"), "c_acctbal")
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_control_id"), (F.col("o_custkey") % 97 + 1).alias("to_control_id"))
    new = held.filter("document_id = 7 and c_acctbal > 0").withColumn("id", F.col("id") + 1_000_000)
    kept, edges = mapping.rebuild_controls(held, links, new)
    counts = kept.groupBy("document_id").agg(F.count("*").alias("controls"), F.sum("id").alias("ids")).withColumn("kind", F.lit("controls"))
    left = edges.groupBy(F.when(F.col("to_control_id").isNull(), -1).otherwise(F.lit(-2)).alias("document_id")).agg(F.count("*").alias("controls"), F.sum("from_control_id").alias("ids")).withColumn("kind", F.lit("edges"))
    return counts.unionByName(left)


def built_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a tree: regions over nations over customers, whose neighbours by id are their equivalents."""
    node = lambda t, letter, key, up, upper, name: read(spark, sf_dir, t).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(1).alias("document_id"), (F.concat(F.lit(upper), F.col(up).cast("string")) if up else F.lit(None).cast("string")).alias("parent_id"), F.col(name).alias("citation"), F.lit("").alias("title"), F.repeat(F.concat(F.col(name), F.lit(" ")), (F.col(key) % 4).cast("int")).alias("body"))
    held = node("region", "r", "r_regionkey", None, "", "r_name").unionAll(node("nation", "n", "n_nationkey", "n_regionkey", "r", "n_name")).unionAll(node("customer", "c", "c_custkey", "c_nationkey", "n", "c_name"))
    docs = spark.createDataFrame([(1, "iso27001", "2022")], "id int, framework_code string, version_label string")
    links = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("from_id"), F.explode(F.array(*[F.concat(F.lit("c"), (F.col("c_custkey") + k).cast("string")) for k in (1, 2)])).alias("to_id"))
    found = build_chunks(held, docs, links)
    return found.select("control_id", "citation", "context_prefix", F.md5(F.col("content").cast("binary")).alias("content_md5"), "ordinal")


def chunk_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix and content of every document as a control; every third borrows its neighbour's body."""
    held = chunks(spark, sf_dir)
    eq = held.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("framework_code").alias("ef"), F.col("content").alias("eb")).filter("chunk_id % 3 = 0")
    cite = F.concat(F.lit("D-"), F.col("chunk_id").cast("string"))
    other = F.concat(F.lit("D-"), (F.col("chunk_id") + 1).cast("string"))
    prefix = context_prefix(F.col("framework_code"), F.col("version_label"), F.array(F.lit("root"), F.col("status")), F.lit("title"))
    built = held.join(eq, "chunk_id", "left").select("chunk_id", prefix.alias("prefix"), chunk_content(cite, F.lit("title"), F.col("content"), F.col("ef"), other, F.col("eb")).alias("text"))
    return built.select("chunk_id", "prefix", F.md5(F.col("text").cast("binary")).alias("content_md5"), F.length("text").cast("long").alias("length"))


def embedding_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded in rounds: a run that ends after its first, one that goes on, and one after some texts have changed, which embeds these alone. Each document's vector once."""
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("context_prefix"), F.col("text").alias("content"))
    store = Published(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    small = max(1, docs.count() // 5)
    first = embedding.embed_in_rounds(store, docs, "hashed", lambda: embedding.hash_embedder, part_rows=small, parts_a_round=2, most_rounds=1)
    rest = embedding.embed_in_rounds(store, docs, "hashed", lambda: embedding.hash_embedder, part_rows=small, parts_a_round=2)
    none = embedding.embed_in_rounds(store, docs, "hashed", lambda: embedding.hash_embedder)
    changed = docs.withColumn("content", F.when(F.col("context_prefix") == "fr", F.concat_ws(" ", "content", F.lit("changed"))).otherwise(F.col("content")))
    embedding.embed_in_rounds(store, changed, "hashed", lambda: embedding.hash_embedder)
    found = embedding.latest_vectors(store, "hashed", changed)
    rows = store.read("vectors").groupBy("chunk_id").agg(F.count("*").alias("rows"))
    return found.join(rows, "chunk_id").select("chunk_id", "model", "dims", "rows", F.lit(first > 0 and rest > 0 and none == 0).alias("resumed"))


def labelled_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("p_size") > 25, "True").otherwise("")
    body = labelled_body(F.col("p_name"), [("Brand", F.col("p_brand")), ("Large", flag), ("Type", F.col("p_type"))])
    return read(spark, sf_dir, "part").select("p_partkey", body.alias("body"))


def grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as flat cells, A to C of a row, and as rows again."""
    cell = lambda letter, value: F.struct(F.concat(F.lit(letter), F.col("p_partkey").cast("string")).alias("ref"), value.alias("value"))
    cells = read(spark, sf_dir, "part").select(F.inline(F.array(cell("A", F.col("p_name")), cell("B", F.col("p_brand")), cell("C", F.col("p_size").cast("string")))))
    grid = cells.select(cell_row(F.col("ref")).alias("row"), cell_column(F.col("ref")).alias("col"), "value")
    return grid.groupBy("row").pivot("col", ["A", "B", "C"]).agg(F.first("value"))


def page_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, more = status.page(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], status.clamp_limit(0, 20, 100), 40)
    return rows.crossJoin(F.broadcast(more.withColumn("next_offset", F.col("next_offset").cast("int"))))


def _iso_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of publications' pages: numbers of clauses and controls, text, page numbers and furniture, by the part's key."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    main = text(4 + size % 16)
    line = (
        F.when(k % 8 == 0, F.concat(main, F.lit("."), text(k % 9), F.lit(" "), "p_name")).when(k % 8 == 1, F.concat(F.lit(" "), main, F.lit(" "), "p_name")).when(k % 8 == 2, F.col("p_name"))
        .when(k % 8 == 3, F.concat(F.lit("CLD."), text(size % 5 + 5), F.lit("."), text(k % 4), F.when(size % 2 == 0, F.concat(F.lit("."), text(k % 3))).otherwise(""), F.lit(" "), "p_type")).when(k % 8 == 4, F.when(size % 3 == 0, "ISO/IEC 27001:2022(E)").otherwise(F.col("p_type")))
        .when(k % 8 == 5, F.when(size % 2 == 0, text(size)).otherwise("")).when(k % 8 == 6, F.when(size % 6 == 0, "Table A.1 (continued)").otherwise(F.concat("p_name", F.lit(" ... 12"))))
        .otherwise(F.concat(main, F.lit("."), text(k % 5), F.lit("."), text(size % 3), F.lit(" "), "p_type"))
    )
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("doc"), text(size % 5)).alias("doc_key"), (k % 30 + 1).cast("int").alias("page"), k.alias("k"), line.alias("line"))
    return part.groupBy("doc_key", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def iso_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of a publication with clauses and an annex, and of one with sections and cloud controls, from the same pages."""
    pages = durable(_iso_pages(spark, sf_dir), "pages")
    each = [iso.iso_tree(pages, f).withColumn("framework_code", F.lit(f)) for f in ("iso27001", "iso27017")]
    found = each[0].unionByName(each[1])
    return found.select("framework_code", "doc_key", "ordinal", "citation", "kind", "title", F.md5(F.coalesce("body", F.lit("-")).cast("binary")).alias("body"), "parent")


def json_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.from_json("props", "k long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(typed["k"]).alias("k"), F.count_if(typed["k"].isNull()).alias("rejected"))


def _golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every benchmark item asks with its whole text, and each document is expected by one of them; hits by BM25, all cases in one job."""
    items = read(spark, sf_dir, "benchmark")
    docs = read(spark, sf_dir, "documents")
    cases, expected = _cases(spark, sf_dir)
    asked = lexical.query_terms(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    best = lexical_index(spark, sf_dir).best_many(asked, {1: Arm(8)})
    top = best.select("query_id", F.col("key").alias("doc_id"), "rank").join(docs.select("doc_id", "source", "lang"), "doc_id")
    hits = top.select(F.col("query_id").alias("case_id"), "rank", F.upper("source").alias("framework_code"), F.col("lang").alias("version_label"), F.col("doc_id").cast("string").alias("citation_norm"), (F.col("lang") == "en").alias("is_current"))
    return cases, expected, hits


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = read(spark, sf_dir, "benchmark")
    cases = items.select(F.col("item_id").alias("case_id"), (F.col("item_id") % 12 == 0).alias("expect_abstain"), (F.col("item_id") % 20 == 8).alias("expect_fail"))
    n = items.agg(F.greatest(F.max("item_id") + 1, F.lit(1)).alias("n"))  # one row
    expected = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("n")).alias("case_id"), F.col("source").alias("framework_code"), F.col("lang").alias("version_label"), F.col("doc_id").cast("string").alias("citation_norm"))
    return cases, expected


def _asked_in_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item twice: in the open lane, and in one that names the framework and version of the first document it expects. Its vector is that of its id."""
    _, expected = _cases(spark, sf_dir)
    pinned = expected.groupBy("case_id").agg(F.min_by(F.struct("framework_code", "version_label"), F.col("citation_norm").cast("long")).alias("p"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding")
    held = items.join(vectors, "case_id", "left").join(pinned, "case_id", "left").crossJoin(spark.createDataFrame([("open",), ("pinned",)], "lane string"))
    named = lambda c: F.when((F.col("lane") == "pinned") & F.col("p").isNotNull(), F.col(f"p.{c}")).otherwise("")
    return held.select(F.concat_ws(":", "lane", F.col("case_id").cast("string")).alias("query_id"), "case_id", "lane", "query", "embedding", named("framework_code").alias("framework"), named("version_label").alias("version"))


def _lane_hits(spark: SparkSession, sf_dir: str, o: retrieval.Options = retrieval.Options(), lane: str = "") -> DataFrame:
    asked = _asked_in_lanes(spark, sf_dir)
    asked = asked.filter(F.col("lane") == lane) if lane else asked
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.search_many(chunk_keys(spark, sf_dir), vectors, asked, lexical_index(spark, sf_dir), o)


def hybrid_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes' hits of every benchmark item, one job."""
    return _lane_hits(spark, sf_dir).select("query_id", "rank", "chunk_id", "score", "vector_rank", "bm25_rank")


def eval_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of either lane of hybrid search over every benchmark item, and which floors the open one misses."""
    cases, expected = _cases(spark, sf_dir)
    found = durable(_lane_hits(spark, sf_dir).join(chunk_keys(spark, sf_dir), "chunk_id"), "lane-hits")
    lane, case = F.split("query_id", ":")[0], F.split("query_id", ":")[1].cast("long")
    hits = found.select(lane.alias("lane"), case.alias("case_id"), "rank", "framework_code", "version_label", F.col("chunk_id").cast("string").alias("citation_norm"), "is_current")
    both = evaluation.lanes(cases, expected, hits.filter("lane = 'open'").drop("lane"), hits.filter("lane = 'pinned'").drop("lane"))
    misses = both["gate"].agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("missed"))
    return both["open"].withColumn("lane", F.lit("open")).crossJoin(F.broadcast(misses)).unionByName(both["pinned"].withColumns({"lane": F.lit("pinned"), "missed": F.lit("")}))


#: How deep a pool is probed.
POOL = 50


def eval_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what is expected a pool of POOL hits of the open lane holds, and how deep its first ones lie."""
    _, expected = _cases(spark, sf_dir)
    deep = retrieval.Options(top_k=POOL, vector_k=POOL, bm25_k=POOL, doc_cap=POOL)
    found = _lane_hits(spark, sf_dir, deep, "open").join(chunk_keys(spark, sf_dir), "chunk_id")
    pool = durable(found.select(F.split("query_id", ":")[1].cast("long").alias("case_id"), "rank", "framework_code", "version_label", F.col("chunk_id").cast("string").alias("citation_norm")), "pool")
    first = pool.join(expected, ["case_id", *evaluation.KEYS]).groupBy("case_id").agg(F.min("rank").alias("rank"))
    ranks = first.agg(F.count("*").alias("cases"), F.max("rank").alias("deepest"))
    return evaluation.pool_recall(expected, pool).crossJoin(F.broadcast(ranks))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_metrics(*_golden(spark, sf_dir)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(evaluation.case_metrics(*_golden(spark, sf_dir)))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_rows(evaluation.case_metrics(*_golden(spark, sf_dir)))


def eval_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.dry_run(*_cases(spark, sf_dir))


def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gate(eval_summary(spark, sf_dir))


_M = """m as (select 'orders/' || o_orderkey || '.pdf' as rel_path, o_totalprice::decimal(12,2)::varchar as sha256, case when o_orderpriority not like '5%' then o_orderpriority end as framework_code, o_orderstatus as version_label,
        case when o_orderkey % 7 = 0 then 'amendment' when o_orderkey % 7 = 1 then 'guide' when o_orderkey % 7 = 2 then 'companion-workbook' when o_orderkey % 7 <> 3 then 'main' end as doc_role, o_orderpriority like '4%' as ignored,
        case when o_orderkey % 50 = 9 then 'bad magic' end as stage_error, case when o_orderkey % 11 = 5 then 'removed' else 'active' end as status, case when o_orderstatus <> 'O' then o_orderdate end as extracted_at,
        case when o_orderstatus = 'F' then o_orderdate end as normalized_at, o_orderkey as k from orders)"""
_DUE = "status = 'active' and not ignored and framework_code is not null and doc_role not in ('guide', 'changelog')"
_STATUS = f"""{CHUNKS}, o as (select o_orderkey as f, case when o_orderstatus <> 'O' then o_custkey end as t from orders),
    c as (select framework_code, version_label, count(*) as controls, count(*) filter (status = 'withdrawn') as withdrawn, count(*) filter (status = 'active') as chunks from chunks group by 1, 2),
    e as (select framework_code, version_label, count(*) as embeddings from chunks join embeddings on vec_id = doc_id where status = 'active' group by 1, 2),
    x as (select framework_code, version_label, count(*) as mapping_edges, count(t) as resolved, count(*) filter (t is null) as unresolved from o join chunks on doc_id = f group by 1, 2),
    i as (select framework_code, version_label, count(*) as inbound_edges from o join chunks on doc_id = t group by 1, 2),
    s as (select framework_code, version_label, 1::bigint as documents, controls, withdrawn, chunks, coalesce(embeddings, 0) as embeddings, coalesce(mapping_edges, 0) as mapping_edges, coalesce(resolved, 0) as resolved, coalesce(unresolved, 0) as unresolved, coalesce(inbound_edges, 0) as inbound_edges
        from c left join e using (framework_code, version_label) left join x using (framework_code, version_label) left join i using (framework_code, version_label))"""
_STOP = ", ".join(f"'{w}'" for w in ("what", "how", "which", "does", "the", "for", "and", "are", "is", "of", "that", "a", "to", "in", "an", "control", "requirement", "cover", "address"))
_EVAL = f"""asked as (select distinct item_id as case_id, term from (select item_id, unnest({TOKENS.format("text")}) as term from benchmark) where term not in ({_STOP})),
    scored as (select case_id, doc_id, round(sum(w), 6) as score from weights join asked using (term) group by 1, 2),
    ranked as (select case_id, doc_id, row_number() over (partition by case_id order by score desc, doc_id) as rank from scored where score > 0),
    hits as (select case_id, rank, lower(source) as f, lang as v, doc_id::varchar as c, lang = 'en' as cur from ranked join documents using (doc_id) where rank <= 8),
    cases as (select item_id as case_id, item_id % 12 = 0 as expect_abstain, item_id % 20 = 8 as expect_fail from benchmark),
    want as (select doc_id % (select max(item_id) + 1 from benchmark) as case_id, source as f, lang as v, doc_id::varchar as c from documents),
    rec as (select w.case_id, count(*) as want, count(h.rank) as found, min(h.rank) as first from want w left join (select case_id, f, v, c, min(rank) as rank from hits group by all) h using (case_id, f, v, c) group by 1),
    good as (select h.*, cur or exists (select 1 from want w where w.case_id = h.case_id and w.f = h.f and w.v = h.v) as ok from hits h),
    last as (select case_id, max(rank) filter (ok) as last from good group by 1),
    cur as (select case_id, count(*) filter (ok) as ok, count(*) as returned from good join last using (case_id) where last is null or rank <= last group by 1),
    metrics as (select case_id, expect_abstain, expect_fail, coalesce(found, 0) as found, coalesce(want, 0) as want, coalesce(1.0 / first, 0.0)::double as rr, coalesce(ok, 0) as ok, coalesce(returned, 0) as returned, expect_abstain = (coalesce(returned, 0) = 0) as abstain_ok from cases left join rec using (case_id) left join cur using (case_id)),
    agg as (select count(*) as cases, count(*) filter (want > 0) as recall_cases, count(*) filter (returned > 0) as current_cases, (select count(*) from metrics where expect_fail) as gap_cases, (select count(*) from metrics where expect_fail and want > 0 and found = want) as gap_passes, round(coalesce(sum(found) / nullif(sum(want), 0), 0), 6)::double as recall, round(coalesce(sum(rr) filter (want > 0) / nullif(count(*) filter (want > 0), 0), 0), 6)::double as mrr,
        round(coalesce(sum(ok) / nullif(sum(returned), 0), 0), 6)::double as current, round(coalesce(count(*) filter (abstain_ok) / nullif(count(*), 0), 0), 6)::double as abstain from metrics where not expect_fail)"""

# headings and furniture as each publication has them; a first sighting opens a section, in the annex a line is its own body
_ISO = r"""l as (select 'doc' || p_size % 5 as d, p_partkey % 30 + 1 as page, p_partkey as k, trim(case p_partkey % 8 when 0 then (4 + p_size % 16) || '.' || p_partkey % 9 || ' ' || p_name when 1 then (4 + p_size % 16) || ' ' || p_name when 2 then p_name
        when 3 then 'CLD.' || (p_size % 5 + 5) || '.' || p_partkey % 4 || case when p_size % 2 = 0 then '.' || p_partkey % 3 else '' end || ' ' || p_type when 4 then case when p_size % 3 = 0 then 'ISO/IEC 27001:2022(E)' else p_type end
        when 5 then case when p_size % 2 = 0 then p_size::varchar else '' end when 6 then case when p_size % 6 = 0 then 'Table A.1 (continued)' else p_name || ' ... 12' end else (4 + p_size % 16) || '.' || p_partkey % 5 || '.' || p_size % 3 || ' ' || p_type end) as t from part),
    tabled as (select distinct d, page from l where t like 'Table A.1%' and page > 10), starts as (select d, min(page) as start from tabled group by 1),
    streams as (select 'iso27001' as f, 0 as s, l.* from l left join starts using (d) where (start is null or page < start) and t <> '' and not regexp_matches(t, '^ISO/IEC 2700|^Table A\.1|All rights reserved|^\d+$|\.\.\.')
        union all select 'iso27001', 1, l.* from l join tabled using (d, page) where t <> '' and not regexp_matches(t, '^ISO/IEC|^Table A\.1|All rights reserved|^\d+$')
        union all select 'iso27017', 0, l.* from l where t <> '' and not regexp_matches(t, '^ISO/IEC|All rights reserved|^\d+$|\.\.\.')),
    marked as (select *, case when f = 'iso27001' and s = 0 then nullif(regexp_extract(t, '^((?:[4-9]|10)(?:\.\d+)*)\s+.', 1), '')
        when f = 'iso27001' then 'A.' || coalesce(nullif(regexp_extract(t, '^([5-8]\.\d+)\s+.', 1), ''), nullif(regexp_extract(t, '^([5-8])\s+.', 1), ''))
        else coalesce(nullif(regexp_extract(t, '^(CLD\.\d+\.\d+(?:\.\d+)?)\s', 1), ''), nullif(regexp_extract(t, '^((?:[5-9]|1[0-8])(?:\.\d+)*)\s+.', 1), '')) end as c from streams),
    opened as (select *, c is not null and row_number() over (partition by f, s, d, c order by page, k) = 1 as opens from marked), parted as (select *, sum(opens::int) over (partition by f, s, d order by page, k) as section from opened),
    sections as (select f, s, d, max(c) filter (opens) as c, max(page * 1000000 + k) filter (opens) as place, max(t) filter (opens) as head, string_agg(t, chr(10) order by page, k) filter (not opens) as told from parted where section > 0 group by f, s, d, section),
    placed as (select *, case when f = 'iso27001' then s else (c like 'CLD%')::int end as g, case when s = 1 then list_transform(string_split(substr(c, 3), '.'), lambda x: x::int) end as num from sections),
    numbered as (select *, (row_number() over (partition by f, d order by g, num nulls first, place) - 1)::int as ordinal, case when c not like '%.%' or regexp_full_match(c, 'CLD\.\d+\.\d+') then null else regexp_replace(c, '\.[^.]*$', '') end as w from placed)"""

_LANES = f"""want as (select doc_id % (select max(item_id) + 1 from benchmark) as case_id, source as f, lang as v, doc_id as d from documents),
    pin as (select case_id, arg_min(f, d) as f, arg_min(v, d) as v from want group by 1),
    q as materialized (select lane || ':' || item_id as q, item_id as case_id, lane, case when lane = 'pinned' then coalesce(f, '') else '' end as f, case when lane = 'pinned' then coalesce(v, '') else '' end as v from benchmark left join pin on case_id = item_id, (values ('open'), ('pinned')) l(lane) where text <> ''),
    terms as (select distinct item_id as case_id, term from (select item_id, unnest({TOKENS.format("text")}) as term from benchmark) where term not in ({_STOP})),
    scored as materialized (select case_id, doc_id, round(sum(w), 6) as score from weights join terms using (term) group by 1, 2 having round(sum(w), 6) > 0),
    cos as materialized (select q.vec_id as case_id, e.vec_id as doc_id, {COSINE} as similarity from embeddings e, embeddings q where q.vec_id in (select case_id from q)),
    ok as materialized (select q, case_id, doc_id, c.is_current, c.framework_code, c.version_label, q.v as pinned, case when q.v <> '' then c.version_label = q.v else c.is_current end as main from q join chunks c on c.status = 'active' and (q.f = '' or c.framework_code = q.f)),
    near as (select q, doc_id, row_number() over (partition by q order by similarity desc, doc_id) as r from ok join cos using (case_id, doc_id) where main qualify r <= 50),
    words as (select q, doc_id, row_number() over (partition by q order by score desc, doc_id) as r from ok join scored using (case_id, doc_id) where main qualify r <= 50),
    fused as (select coalesce(n.q, w.q) as q, coalesce(n.doc_id, w.doc_id) as doc_id, round(coalesce(1.0 / (20 + n.r), 0) + coalesce(0.5 / (20 + w.r), 0), 9)::double as score, coalesce(n.r, 0)::int as vr, coalesce(w.r, 0)::int as br from near n full join words w on n.q = w.q and n.doc_id = w.doc_id),
    main as (select *, 1 as arm, row_number() over (partition by q order by score desc, doc_id) as r from fused qualify r <= 8),
    old_near as (select q, doc_id, framework_code, version_label, row_number() over (partition by q order by similarity desc, doc_id) as r, true as dense from ok join cos using (case_id, doc_id) where not is_current and pinned = '' qualify r <= 3),
    old_words as (select q, doc_id, framework_code, version_label, row_number() over (partition by q order by score desc, doc_id) as r, false as dense from ok join scored using (case_id, doc_id) where not is_current and pinned = '' and case_id not in (select vec_id from embeddings) qualify r <= 3),
    older as (select * from (select * from old_near union all select * from old_words) qualify row_number() over (partition by q, framework_code, version_label order by r) = 1),
    listed as (select q, doc_id, score, vr, br, arm, r from main union all select q, doc_id, 0.0, case when dense then r else 0 end, case when dense then 0 else r end, 2, r from older o where not exists (select 1 from main m where m.q = o.q and m.doc_id = o.doc_id)),
    many as materialized (select q, (row_number() over (partition by q order by arm, r, doc_id))::int as rank, doc_id, score, vr::int as vr, br::int as br from listed)"""


def _lane_sql(lane: str) -> str:
    """The summary's SQL over one lane's hits."""
    hits = _EVAL[_EVAL.index("    cases as") :]
    return f"select * from (with hits as (select case_id, rank, lower(source) as f, d.lang as v, doc_id::varchar as c, d.lang = 'en' as cur from many m join q on q.q = m.q join documents d using (doc_id) where q.lane = '{lane}'), {hits.strip()} select *, '{lane}' as lane from agg)"


QUERIES = {f.__name__: f for f in (corpus_status, corpus_totals, framework_versions, stage_eligible, deferred_docs, manifest_gaps, manifest_listings, registry_listings, point_lookups, manifest_upsert, stage_mark, reseed_overlay, ambiguity, duplicate_keys, orphans, missing_embeddings, latest_capture, source_url_min, glob_rules, chunk_build, embedding_rounds, labelled_bodies, grid_pivot, page_lookahead, iso_trees, json_capture, hybrid_many, eval_lanes, eval_pool, eval_metrics, eval_summary, eval_gate, eval_cases, eval_dry_run, document_upsert, edge_upsert, relation_upsert, control_rebuild, built_chunks)}


def _oracles() -> dict[str, str]:
    from tessera.plans.tables import WEIGHTS

    case = lambda what: "case " + " ".join(f"when regexp_full_match(url, '{p}') then {what(k)}" for k, p in enumerate(LIKE) if p) + " end"
    return {
        "corpus_status": f"with {_STATUS} select * from s",
        "corpus_totals": f"with {_STATUS} select count(distinct framework_code) as frameworks, count(*) as versions, " + ", ".join(f"sum({c})::bigint as {c}" for c in status.COUNTS) + " from s",
        "framework_versions": "select source as framework_code, string_agg(distinct lang, ',' order by lang) as versions from documents group by 1",
        "stage_eligible": f"with {_M} select rel_path, 'extracted_at' as stage from m where {_DUE} and extracted_at is null union all select rel_path, 'normalized_at' from m where {_DUE} and extracted_at is not null and normalized_at is null union all select rel_path, 'indexed_at' from m where {_DUE} and normalized_at is not null",
        "deferred_docs": f"with {_M} select framework_code, version_label, doc_role, case doc_role when 'amendment' then 'amendment parsing deferred' when 'companion-workbook' then 'companion-workbook parsing deferred' else 'parsing not yet implemented' end as reason, count(*) as files from m where framework_code is not null and not ignored and doc_role not in ('guide', 'changelog') and framework_code <> '1-URGENT' and version_label <> 'P' group by 1, 2, 3, 4",
        "manifest_gaps": f"with {_M} select rel_path, sha256, case when framework_code is null and not ignored then 'unrecognized' else 'error' end as status, coalesce(stage_error, '') as error from m where (framework_code is null and not ignored) or stage_error is not null",
        "manifest_listings": f"with {_M}, a as (select * from m where status = 'active') select 'active' as listing, rel_path from a union all select 'unrecognized', rel_path from a where not ignored and framework_code is null union all select 'ignored', rel_path from a where ignored",
        "registry_listings": "with v as (select lower(r_name) as f, n_name as v, n_nationkey % 5 = 1 as cur from nation join region on r_regionkey = n_regionkey) select 'frameworks' as listing, row_number() over (order by lower(r_name)) as place, lower(r_name) as name from region union all select 'versions', row_number() over (order by f, v), f || ' ' || v from v union all select 'current_versions', row_number() over (order by f, v), f || ' ' || v from v where cur union all select 'reference_sources', row_number() over (order by s_name), s_name from supplier where s_acctbal > 0 union all select 'controls', row_number() over (order by p_size, p_partkey, p_name), p_name from part where p_brand = 'Brand#1'",
        "point_lookups": f"with {_M} select 'path' as by, rel_path, sha256 from m where rel_path = 'orders/7.pdf' union all select 'unknown framework', rel_path, sha256 from m where framework_code is null and version_label = 'P'",
        "manifest_upsert": f"with {_M} select rel_path, case when k % 10 = 4 then sha256 || 'x' else sha256 end as sha256, case when k % 10 <> 3 then 'active' when status = 'active' then 'removed' else status end as status, k % 10 <> 4 and extracted_at is not null as extracted, k % 10 <> 4 and normalized_at is not null as normalized from m union all select 'new/' || n_name, 'n', 'active', false, false from nation",
        "stage_mark": f"with {_M} select version_label, case when version_label = 'P' then '2024-01-01' else coalesce(normalized_at::date::varchar, '-') end as normalized, version_label <> 'P' and stage_error is not null as failed, count(*) as files from m group by 1, 2, 3",
        "reseed_overlay": "with u as (select (n_nationkey + 20)::int as n_nationkey, lower(n_name) as n_name from nation where n_nationkey % 4 = 1) select *, 'user' as origin from u union all select n_nationkey, n_name, 'seed' from nation where n_nationkey not in (select n_nationkey from u)",
        "ambiguity": "select n > 1 as is_ambiguous, count(*) as rows, sum(l_partkey)::bigint as parts from (select l_partkey, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) group by 1",
        "duplicate_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
        "orphans": "select doc_id as id, doc_id * 2 as control_id, doc_id * 2 in (select doc_id from documents) as kept from labels",
        "missing_embeddings": "select doc_id as id, source from documents where not exists (select 1 from embeddings where vec_id = doc_id and label = 1)",
        "latest_capture": "select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2",
        "source_url_min": "with u as (select page_id % 60 as s, min(url) as url from pages where page_id % 60 < 50 group by 1) select doc_id as id, coalesce(url, '') as source_url from documents left join u on s = doc_id % 70",
        "glob_rules": f"select page_id, ({case(str)})::int as ordinal, {case(lambda k: repr(RULES[k][1]))} as identity from pages",
        "chunk_build": f"with {CHUNKS}, b as (select a.doc_id as chunk_id, a.framework_code || ' ' || a.version_label || ' > root > ' || a.status || ' > title' as prefix, 'D-' || a.doc_id || ' title' || case when a.text <> '' then chr(10) || a.text else '' end || case when a.doc_id % 3 = 0 and e.text <> '' then chr(10) || chr(10) || '[equivalent ' || e.framework_code || ' D-' || e.doc_id || ']' || chr(10) || e.text else '' end as text from chunks a left join chunks e on e.doc_id = a.doc_id + 1) select chunk_id, prefix, md5(text) as content_md5, length(text) as length from b",
        "embedding_rounds": "select doc_id as chunk_id, 'hashed' as model, 64 as dims, case when lang = 'fr' then 2 else 1 end as rows, true as resumed from documents",
        "labelled_bodies": "select p_partkey, p_name || chr(10) || chr(10) || 'Brand: ' || p_brand || chr(10) || case when p_size > 25 then 'Large: Yes' || chr(10) else '' end || 'Type: ' || p_type as body from part",
        "grid_pivot": 'select p_partkey::int as "row", p_name as "A", p_brand as "B", p_size::varchar as "C" from part',
        "page_lookahead": "with a as (select doc_id, source from documents order by source, doc_id limit 21 offset 40) select doc_id, source, (select case when count(*) > 20 then 60 end from a)::int as next_offset from (select * from a order by source, doc_id limit 20)",
        "iso_trees": f"with {_ISO} select n.f as framework_code, n.d as doc_key, n.ordinal, n.c as citation, case when n.f = 'iso27017' then 'control' when n.s = 0 then 'clause' when n.c like 'A.%.%' then 'annex-control' else 'domain' end as kind, case when n.f = 'iso27017' then 'Control ' when n.s = 0 then 'Clause ' when n.c like 'A.%.%' then 'Annex A control ' else 'Annex A theme ' end || n.c as title, md5(coalesce(nullif(case when n.s = 1 then case when n.c like 'A.%.%' then trim(regexp_replace(n.head, '^[0-9.]+', '')) end else n.told end, ''), '-')) as body, p.c as parent from numbered n left join numbered p on p.f = n.f and p.d = n.d and p.c = n.w and p.ordinal < n.ordinal",
        "json_capture": "select event_type, count(*) as n, sum((props->>'k')::bigint)::bigint as k, count(*) filter (props->>'k' is null) as rejected from events group by 1",
        # on conflict of the key only title, capture, gate and markdown are set; the row that was inserted first keeps the rest
        "document_upsert": "with o as (select o_custkey || '|' || o_orderpriority as doc_key, o_orderkey as id, lower(o_orderpriority) as framework_code, o_orderstatus as version_label, 'order ' || o_orderkey as title, md5(o_orderkey::varchar) as source_file_sha256, case when o_orderkey % 3 = 0 then 'internal' else 'open' end as serve_gate, case when o_orderkey % 5 = 0 then o_orderpriority end as markdown from orders), old as (select * from o where id % 2 = 0 qualify row_number() over (partition by doc_key order by id desc) = 1), base as (select * from old union all select * from (select * from o where id % 2 = 1 and doc_key not in (select doc_key from old) qualify row_number() over (partition by doc_key order by id) = 1)), last as (select * from o where id % 2 = 1 qualify row_number() over (partition by doc_key order by id desc) = 1) select b.doc_key, b.id, b.framework_code, b.version_label, case when l.id is null then b.title else l.title end as title, case when l.id is null then b.source_file_sha256 else l.source_file_sha256 end as source_file_sha256, case when l.id is null then b.serve_gate else l.serve_gate end as serve_gate, case when l.id is null then b.markdown else l.markdown end as markdown from base b left join last l using (doc_key)",
        # on conflict only relationship and provenance are set; a resolved target stays, and an inserted edge has none
        "edge_upsert": "with r as (select l_orderkey as f, case when l_returnflag <> 'N' then l_returnflag end as v, (l_partkey % 5)::varchar as norm, l_linestatus as s, 'r' || l_suppkey % 3 as relationship, l_linenumber as n, l_partkey as p, row_number() over (partition by l_orderkey, l_returnflag, l_partkey % 5, l_linestatus, l_linenumber > 2 order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as k from lineitem), a as (select * from r where n <= 2 and k = 1), b as (select * from r where n > 2 and k = 1), u as (select coalesce(a.v, b.v) as v, coalesce(a.s, b.s) as s, coalesce(a.norm, b.norm) as norm, coalesce(b.relationship, a.relationship) as relationship, coalesce(b.n, a.n) as n, a.p from a full join b on a.f = b.f and a.v is not distinct from b.v and a.norm = b.norm and a.s = b.s) select v as to_version_label, s as mapping_source_code, norm as to_citation_norm, relationship, count(*) as edges, sum(n)::bigint as lines, count(p) as resolved, sum(p)::bigint as targets from u group by 1, 2, 3, 4",
        "relation_upsert": "select lower(n_name) as from_framework_code, 'v2' as from_version_label, lower(n_name) as to_framework_code, 'v1' as to_version_label, 'supersedes' as relation_type, case when lower(n_name) < 'g' then 'new' else 'old' end as note from nation union all select 'ciscontrols', 'v8.1', 'ciscontrols', 'v8', 'supersedes', 'v8.1 supersedes v8' union all select 'csaccm', 'v4.1', 'csaccm', 'v4.0', 'supersedes', 'v4.1 supersedes v4.0'",
        "control_rebuild": "with gone as (select c_custkey as id from customer where c_nationkey = 7), kept as (select c_custkey as id, c_nationkey as d from customer where c_nationkey <> 7 union all select c_custkey + 1000000, 7 from customer where c_nationkey = 7 and c_acctbal > 0), e as (select o_custkey as f, o_custkey % 97 + 1 as t from orders where o_custkey not in (from gone)) select d as document_id, count(*) as controls, sum(id)::bigint as ids, 'controls' as kind from kept group by 1 union all select case when t in (from gone) then -1 else -2 end, count(*), sum(f)::bigint, 'edges' from e group by 1",
        "built_chunks": "with c as (select c_custkey as k, c_nationkey as n, c_name as name, repeat(c_name || ' ', (c_custkey % 4)::int) as body from customer), eq as (select f.k as f, t.name as cite, t.body as body from c f join c t on t.k in (f.k + 1, f.k + 2) where length(t.body) > length(f.body) qualify row_number() over (partition by f.k order by length(t.body) desc, 'c' || t.k) = 1), own as (select 'r' || r_regionkey as control_id, r_name as citation, 'iso27001 2022' as context_prefix, repeat(r_name || ' ', (r_regionkey % 4)::int) as body, '' as more from region union all select 'n' || n_nationkey, n_name, 'iso27001 2022 > ' || r_name, repeat(n_name || ' ', (n_nationkey % 4)::int), '' from nation join region on r_regionkey = n_regionkey union all select 'c' || k, name, 'iso27001 2022 > ' || r_name || ' > ' || n_name, c.body, coalesce(chr(10) || chr(10) || '[equivalent iso27001 ' || cite || ']' || chr(10) || eq.body, '') from c join nation on n_nationkey = n join region on r_regionkey = n_regionkey left join eq on f = k) select control_id, citation, context_prefix, md5(citation || case when body = '' then '' else chr(10) || body end || more) as content_md5, 0 as ordinal from own",
        "hybrid_many": f"with {WEIGHTS}, {CHUNKS}, {_LANES} select q as query_id, rank, doc_id as chunk_id, score, vr as vector_rank, br as bm25_rank from many",
        "eval_lanes": f"with {WEIGHTS}, {CHUNKS}, {_LANES}, both_lanes as ({_lane_sql('open')} union all {_lane_sql('pinned')}) select *, case when lane = 'open' then concat_ws(',', case when cases > 0 and abstain < 0.9 then 'abstain' end, case when current_cases > 0 and current < 0.98 then 'current' end, case when recall_cases > 0 and mrr < 0.44 then 'mrr' end, case when recall_cases > 0 and recall < 0.66 then 'recall' end) else '' end as missed from both_lanes",
        "eval_pool": f"with {WEIGHTS}, {CHUNKS}, {_LANES.replace('qualify r <= 8', f'qualify r <= {POOL}')}, hit as (select q.case_id, m.rank, d.doc_id as d from many m join q on q.q = m.q join documents d using (doc_id) where q.lane = 'open'), j as (select w.case_id, h.rank from want w left join hit h on h.case_id = w.case_id and h.d = w.d) select count(rank) as found, count(*) as want, round(count(rank) / count(*), 6)::double as recall, count(distinct case_id) filter (rank is not null) as cases, (select max(r) from (select min(rank) as r from j group by case_id))::int as deepest from j",
        "eval_cases": f"with {WEIGHTS}, {_EVAL} select case_id, returned = 0 as abstained, found || '/' || want as recall, case when rr > 0 then round(1 / rr)::int end as rank, case when returned > 0 then round(100.0 * ok / returned)::int else 0 end as current, case when expect_fail then case when want > 0 and found = want then 'GAP-PASS' else 'GAP' end when abstain_ok then 'PASS' else 'FAIL' end as outcome from metrics",
        "eval_dry_run": f"with c as (select item_id as id, item_id % 12 = 0 as a, item_id % 20 = 8 as f, item_id in (select doc_id % (select max(item_id) + 1 from benchmark) from documents) as w from benchmark) select count(*) as total, count(*) filter (not a and not f) as in_scope, count(*) filter (a) as abstaining, count(*) filter (f and not a) as failing, count(*) filter (not f) as cases, count(*) filter (not f and w) as recall_cases, 0::bigint as current_cases, count(*) filter (f) as gap_cases, 0::bigint as gap_passes, 0.0::double as recall, 0.0::double as mrr, 0.0::double as current, round(count(*) filter (not f and a) / count(*) filter (not f), 6)::double as abstain from c",
        "eval_metrics": f"with {WEIGHTS}, {_EVAL} select case_id, expect_abstain, expect_fail, found, want, round(rr, 6) as reciprocal_rank, ok, returned, abstain_ok from metrics",
        "eval_summary": f"with {WEIGHTS}, {_EVAL} select * from agg",
        "eval_gate": f"with {WEIGHTS}, {_EVAL} select metric, value, floor from (select 'recall' as metric, recall as value, 0.66::double as floor, recall_cases as n from agg union all select 'mrr', mrr, 0.44, recall_cases from agg union all select 'current', current, 0.98, current_cases from agg union all select 'abstain', abstain, 0.9, cases from agg) where n > 0 and value < floor",
    }


ORACLES = _oracles()
