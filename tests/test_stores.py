"""Published versions, the stored lexical index, merges by column and pointer doubling."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical, state, tree
from tessera.operators.lexical_store import LexicalStore
from tessera.published import Published


def ids(df):
    return sorted(r.id for r in df.collect())


def test_readers_see_one_version_whole(spark, tmp_path):
    store = Published(spark, str(tmp_path / "corpus"))
    assert store.version() == 0 and store.listed() == {}
    with pytest.raises(ValueError):
        store.read("controls")
    assert store.replace({"controls": spark.range(3), "edges": spark.range(5)}) == 1
    before = store.read("controls")
    assert store.replace({"controls": spark.range(10, 12)}) == 2
    assert ids(store.read("controls")) == [10, 11] and ids(store.read("edges")) == [0, 1, 2, 3, 4]
    assert ids(store.read("controls", 1)) == [0, 1, 2] and ids(before) == [0, 1, 2]
    assert store.append({"edges": spark.range(5, 7)}) == 3 and ids(store.read("edges")) == list(range(7))
    assert store.versions() == [1, 2, 3]


def test_a_failed_rebuild_leaves_the_old_version(spark, tmp_path):
    store = Published(spark, str(tmp_path / "corpus"))
    store.replace({"controls": spark.range(3), "edges": spark.range(5)})
    broken = spark.range(4).select(F.raise_error(F.lit("no parse")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no parse"):
        store.replace({"controls": spark.range(100, 104), "edges": broken})  # the first table is written by then
    assert store.version() == 1 and ids(store.read("controls")) == [0, 1, 2]
    gone = store.expire()
    assert len(gone) >= 1 and ids(store.read("edges")) == [0, 1, 2, 3, 4]


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = (Published(spark, str(tmp_path / "corpus")) for _ in range(2))
    one.replace({"t": spark.range(1)})
    one.replace({"t": spark.range(2)}, after=1)
    with pytest.raises(RuntimeError):
        two.replace({"t": spark.range(3)}, after=1)
    assert ids(two.read("t")) == [0, 1]
    two.replace({"t": spark.range(3)})
    two.expire(keep=1)
    assert one.versions() == [3] and ids(one.read("t")) == [0, 1, 2]


def contents(store):
    postings = sorted((r.doc_id, r.term, r.tf, r.dl) for r in store.postings().collect())
    return postings, sorted(tuple(r) for r in store.frequencies().collect()), tuple(store.statistics().first())


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", *[" ".join(rng.choices(["risk", "ac-2", "access", "AC-2(1)", "8.3.6", "the", "log"], k=rng.randint(1, 9))) for _ in range(6)]])
    schema = "doc_id long, text string"
    held = {k: text() for k in range(40)}
    store = LexicalStore(spark, str(tmp_path / "batches"), buckets=3)
    store.build(spark.createDataFrame(list(held.items()), schema))
    for batch in range(3):
        changed = {k: text() for k in rng.sample(range(40 + 10 * batch, 60 + 10 * batch), 8)} | {k: text() for k in rng.sample(sorted(held), 8)}
        removed = rng.sample(sorted(held), 6) + [999]
        for k in removed:
            held.pop(k, None)
        held |= changed
        store.apply(spark.createDataFrame(list(changed.items()), schema), spark.createDataFrame([(k,) for k in removed], "doc_id long"))
        anew = LexicalStore(spark, str(tmp_path / f"anew{batch}"), buckets=3)
        docs = spark.createDataFrame(list(held.items()), schema)
        anew.build(docs)
        assert contents(store) == contents(anew)
        for query in ("what access to AC-2", "log", "nothing"):
            want = [tuple(r) for r in lexical.top_k(docs, query, 7).collect()]
            assert [tuple(r) for r in lexical.best(store.asked(lexical.terms_of(spark, query)), 7).collect()] == want
    assert store.compact() == 5 and contents(store) == contents(anew) and len(store.published.listed()["postings"]) == 1


def test_each_file_of_postings_is_one_task_of_bounded_size(spark, tmp_path, monkeypatch):
    from tessera.operators import lexical_store

    monkeypatch.setattr(lexical_store, "POSTINGS", 50)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), (F.col("id") % 7).cast("string")) for k in range(12)]).alias("text"))
    store = LexicalStore(spark, str(tmp_path / "sizes"), buckets=3)
    store.build(docs)
    held = store.published.read("postings").groupBy(F.col("_metadata.file_path"), "bucket").count().collect()
    assert sum(r["count"] for r in held) == 200 * 12
    assert len(held) == len({r.file_path for r in held}) <= 3 * 16 and max(r["count"] for r in held) <= 150  # by hashed buckets, tasks wrote up to 4 files' rows


def test_best_of_many_against_all_scores(spark, tmp_path, monkeypatch):
    """In blocks of queries and batches of documents, after a second batch, with ties; and with no query at all."""
    from pyspark.sql import Window
    from tessera.operators import lexical_many

    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 9, 40])))) for k in range(120)] + [(500, "w1 w2"), (501, "w1 w2"), (502, None)]
    store = LexicalStore(spark, str(tmp_path / "many"), buckets=3)
    store.build(spark.createDataFrame(docs, "doc_id long, text string").filter("doc_id < 100 or doc_id > 400"))
    store.apply(spark.createDataFrame([(k, t) for k, t in docs if 95 <= k < 400], "doc_id long, text string"))
    terms = lexical.query_terms(spark.createDataFrame([(f"q{k}", " ".join(rng.choices(words, k=6))) for k in range(9)] + [("none", "absent")], "query_id string, query string"))
    scored = lexical.score(store.asked_many(terms), terms)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    want = {tuple(r) for r in scored.withColumn("rank", F.row_number().over(order)).filter("rank <= 7").select("query_id", "doc_id", "score", "rank").collect()}
    monkeypatch.setattr(lexical_many, "QUERY_TERMS", 11)
    monkeypatch.setattr(lexical_many, "DOCS", 5)
    found = store.best_many(terms, {1: lexical_many.Arm(7)})
    assert {(r.query_id, r.key, r.score, r["rank"]) for r in found.collect()} == want and len(want) > 50
    assert store.best_many(terms.limit(0), {1: lexical_many.Arm(7)}).count() == 0


def test_empty_index(spark, tmp_path):
    store = LexicalStore(spark, str(tmp_path / "none"), buckets=3)
    store.build(spark.createDataFrame([], "doc_id long, text string"))
    assert contents(store) == ([], [], (0, 1.0)) and store.asked(["risk"]).count() == 0 and store.asked([]).count() == 0


def test_an_index_query_reads_no_text(spark, tmp_path):
    store = LexicalStore(spark, str(tmp_path / "plan"), buckets=3)
    store.build(spark.createDataFrame([(1, "risk of access"), (2, "log")], "doc_id long, text string"))
    plan = lexical.best(store.asked(["risk"]))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket") or "PartitionFilters: [" in plan and "bucket" in plan


def test_counts_within_a_row(spark):
    docs = spark.createDataFrame([(1, "b a b c b"), (1, "b a"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.dl, [tuple(t) for t in r.terms or []]) for r in lexical.counted(docs).collect()]
    assert got == [(1, 5, [("a", 1), ("b", 3), ("c", 1)]), (1, 2, [("a", 1), ("b", 1)]), (2, 0, []), (3, 0, [])]
    assert lexical.term_frequencies(docs).filter("doc_id = 1").count() == 5


def test_merge_by_column(spark):
    schema = "key string, v string, id long, title string, target long, note string"
    old = spark.createDataFrame([("a", None, 1, "old a", 10, "n"), ("b", "x", 2, "old b", None, "n"), ("c", "x", 3, "old c", 30, None)], schema)
    new = spark.createDataFrame([("a", None, 11, "new a", 99, None, 1), ("a", None, 12, None, 98, "m", 2), ("d", None, 13, "first d", 40, None, 1), ("d", None, 14, "last d", 41, "p", 2), ("d", None, 15, "last of all", 42, None, 3), ("c", "y", 16, "c of y", 1, "q", 1)], schema + ", at int")
    got = {(r.key, r.v): tuple(r)[2:] for r in state.merge(old, new, ["key", "v"], ["title"], ["note"], order="at").collect()}
    assert got == {("a", None): (1, None, 10, "m"), ("b", "x"): (2, "old b", None, "n"), ("c", "x"): (3, "old c", 30, None), ("d", None): (13, "last of all", 40, "p"), ("c", "y"): (16, "c of y", 1, "q")}
    once = {r.key: r.target for r in state.merge(old, new.filter("at = 1").drop("at", "target"), ["key", "v"], ["title"]).filter("v is null").collect()}
    assert once == {"a": 10, "d": None}
    with pytest.raises(ValueError):
        state.merge(old, new, ["key", "v"], ["absent"])


def test_ancestors_of_any_depth_and_cycles(spark):
    chain = [(k, k - 1 if k else None, f"c{k}") for k in range(40)]
    rows = [*chain, (100, 999, "orphan"), (101, 100, "below"), (200, 202, "x"), (201, 200, "y"), (202, 201, "z"), (203, 202, "hangs on a cycle"), (300, 300, "own parent")]
    rng = random.Random(1)
    rows += [(1000 + k, rng.choice([None, *range(1000, 1000 + k)]) if k else None, f"r{k}") for k in range(200)]
    up = {i: (p, c) for i, p, c in rows}

    def want(i):
        path, seen, p = [], {i}, up[i][0]
        while p in up:
            if p in seen:
                return None
            seen.add(p)
            path.insert(0, up[p][1])
            p = up[p][0]
        return path

    got = {r.id: r.path for r in tree.ancestors(spark.createDataFrame(rows, "id long, parent_id long, citation string")).collect()}
    assert got == {i: want(i) for i in up}
    assert len(got[39]) == 39 and got[203] is None and got[300] is None and tree.ancestors(spark.createDataFrame([], "id long, parent_id long, citation string")).count() == 0


def test_dealt_ids_and_parents(spark):
    from tessera.operators import numbering

    rows = [(d, o, f"{d}-{o}", f"{d}-{o // 3}" if o and o % 4 else None) for d in range(6) for o in range(0, 40, 1 + d)] + [(9, 1, "child", "missing")]
    table = spark.createDataFrame(rows, "document_id long, ordinal int, citation_norm string, parent_norm string").repartition(5)
    got = {(r.document_id, r.ordinal): r for r in numbering.with_ids(table, 100).collect()}
    order = sorted((d, o) for d, o, *_ in rows)
    assert {k: r.id for k, r in got.items()} == {k: 100 + n for n, k in enumerate(order)}
    norms = {(d, n): got[(d, o)].id for d, o, n, _ in rows}
    assert all(got[(d, o)].parent_control_id == norms.get((d, p)) for d, o, _, p in rows)
    with pytest.raises(ValueError, match="'x' 2 times"):
        numbering.with_ids(spark.createDataFrame([(1, 1, "x", None), (1, 2, "x", None)], table.schema))
    assert numbering.with_ids(table.limit(0)).count() == 0


def test_what_references_are_skipped(spark):
    from tessera.functions.citations import iso_reference
    from tessera.operators import mapping

    lines = spark.createDataFrame([(1, "ISO: 2022: Annex A Controls: 5.1\nCIS: 4.1\n\nno colon"), (2, "ISO: None\nOFF: 2022: Annex A Controls: 5.2\n: empty\nISO : 2022: Mandatory Clause: 4.4"), (3, None)], "from_id long, text string")
    sources = spark.createDataFrame([("ISO", "iso27001", "2022", True), ("OFF", "off", None, False), ("EMPTY", "e", None, True)], "prefix string, to_framework_code string, to_version_label string, enabled boolean")
    edges, seen = mapping.counted_references(lines, sources, lambda prefix, rest: iso_reference(rest))
    assert sorted(tuple(r) for r in edges.collect()) == [(1, "iso27001", "2022", "A.5.1"), (2, "iso27001", "2022", "4.4")]
    assert seen.get == {"lines": 7, "no_prefix": 1, "unknown_prefix": 3, "skipped": 1, "edges": 2, "skipped:ISO": 1, "skipped:EMPTY": 0}


def test_search_of_many_equals_search_of_each(spark, tmp_path):
    from tessera.operators import retrieval

    rng = random.Random(5)
    words = ["risk", "access", "log", "review", "AC-2", "cc6.1", "the", "of", "key"]
    rows = [(k, f"fw{k % 3}", f"v{k % 2 + 1}", k % 2 == 1, rng.choice(["active", "active", "active", "withdrawn", "deprecated"]), f"AC-{k % 9}", k % 4, " ".join(rng.choices(words, k=12))) for k in range(90)]
    chunks = spark.createDataFrame(rows, "chunk_id long, framework_code string, version_label string, is_current boolean, status string, citation_norm string, ordinal int, content string")
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(80)] + [(80, [0.0] * 4), (81, None), (82, [1.0, 2.0])], "chunk_id long, embedding array<float>")
    index = LexicalStore(spark, str(tmp_path / "index"), buckets=3)
    index.build(chunks, "chunk_id", "content")
    asked = [(1, "what of access", [1.0, 0.0, 0.0, 1.0], "", "", False), (2, "ac-2 and ac-3 log", [0.2, -1.0, 0.5, 0.1], "", "", False), (3, "risk", None, "fw1", "", True), (4, "review the key", [0.0, 1.0, 1.0, 0.0], "fw2", "v1", True), (5, "", [1.0, 0.0, 0.0, 0.0], "", "", False), (6, "absent", [0.3, 0.3, 0.3, 0.4], "nowhere", "", False)]
    queries = spark.createDataFrame(asked, "query_id long, query string, embedding array<float>, framework string, version string, include_withdrawn boolean")
    for o in (retrieval.Options(top_k=6, vector_k=9, bm25_k=9, scheme="oscal-catalog"), retrieval.Options(top_k=5, doc_cap=2, current_only=False, scheme="oscal-catalog"), retrieval.Options(mode="bm25", scheme="oscal-catalog")):
        many = {}
        for r in retrieval.search_many(chunks.drop("content"), vectors, queries, index, o).orderBy("query_id", "rank").collect():
            many.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score, r.vector_rank, r.bm25_rank))
        for qid, query, vector, framework, version, withdrawn in asked:
            own = retrieval.replace(o, framework=framework, version=version, include_withdrawn=withdrawn)
            want = [] if not query else [(r["rank"], r.chunk_id, r.score, r.vector_rank, r.bm25_rank) for r in retrieval.search(chunks, vectors if vector else None, query, vector, own, index).orderBy("rank").collect()]
            assert many.get(qid, []) == want, (o, qid)
    with_none = queries.drop("embedding", "framework", "version", "include_withdrawn")
    assert {r.query_id for r in retrieval.search_many(chunks.drop("content", "citation_norm"), vectors, with_none, index).select("query_id").distinct().collect()} == {1, 2, 3, 4}


def test_nearest_of_many_against_all_pairs(spark):
    from tessera.operators import dense

    rng = random.Random(8)
    vectors = [(k, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], k % 4) for k in range(150)] + [(200, None, 0), (201, [0.0] * 3, 1), (202, [1.0], 1), (203, [float("nan"), 1.0, 1.0], 1), (204, [2e-30] * 3, 2)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, tag int").repartition(4)
    asked = table.filter("vec_id % 7 = 0 or vec_id > 199").withColumnRenamed("vec_id", "query_id")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or any(x != x for x in (*a, *b)) or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 6)

    held = {i: (v, t) for i, v, t in vectors}
    for k, apart, allowed in ((5, True, None), (3, False, lambda q, v: q["tag"][:, None] == v["tag"][None])):
        got = {}
        for r in dense.top_k_many(table, asked, k, apart=apart, fields=["tag"], query_fields=["tag"], allowed=allowed, block=16).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.similarity, 6) + 0.0))
        for r in asked.collect():
            all_ = [(-c, i) for i, (v, t) in held.items() if (c := cosine(held[r.query_id][0], v)) is not None and not (apart and i == r.query_id) and (allowed is None or t == r.tag)]
            assert got.get(r.query_id, []) == [(i, -c + 0.0) for c, i in sorted(all_)[:k]]


def test_embedding_goes_on_where_it_was_interrupted(spark, tmp_path):
    from tessera.operators import embedding
    from tessera.published import Published

    store = Published(spark, str(tmp_path / "vectors"))
    chunks = spark.createDataFrame([(k, None if k % 3 else "prefix", f"text {k}" if k % 5 else None) for k in range(60)], "id long, context_prefix string, content string")
    flag = str(tmp_path / "broken")

    def load():
        import os

        def run(texts):
            if os.path.exists(flag) and any("text 41" in t for t in texts):
                raise ValueError("out of memory")
            return embedding.hash_embedder(texts, 8)

        return run

    open(flag, "w").close()
    with pytest.raises(Exception, match="out of memory"):
        embedding.embed_in_rounds(store, chunks, "m", load, part_rows=10, parts_a_round=1)
    kept = store.read("vectors").count() if store.version() else 0
    assert kept < 60
    (tmp_path / "broken").unlink()
    rounds = embedding.embed_in_rounds(store, chunks, "m", load, part_rows=10, parts_a_round=1)
    assert rounds == -(-(60 - kept) // 10)
    got = {r.chunk_id: r.embedding for r in embedding.latest_vectors(store, "m", chunks).collect()}
    assert len(got) == 60 and store.read("vectors").count() == 60
    assert embedding.embed_in_rounds(store, chunks, "m", load) == 0
    assert embedding.embed_in_rounds(store, chunks.filter("id < 3"), "other", load) == 1
    changed = chunks.withColumn("content", F.when(F.col("id") == 7, "new words").otherwise(F.col("content")))
    assert embedding.embed_in_rounds(store, changed, "m", load) == 1 and store.read("vectors").filter("model = 'm'").count() == 61
    assert embedding.latest_vectors(store, "m", changed).count() == 60 and embedding.embed_in_rounds(store, chunks.limit(0), "m", load) == 0


def test_scratch_tables_go(spark):
    import os

    from tessera.durable import durable, scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        assert durable(spark.range(3), "gone").count() == 3 and len(set(os.listdir(folder)) - before) == 1
        with scratch(spark):
            durable(spark.range(3), "inner")
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_a_query_of_few_terms_builds_no_index(spark, tmp_path):
    from tessera.plans import search, tables

    spark.createDataFrame([(3, "thonnt of ering"), (5, "log"), (6, "thonnt"), (7, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda: [tuple(r) for r in search.bm25_topk(spark, str(tmp_path)).collect()]
    before = rows()
    assert [d for d, _ in before] == [3, 6] and not tables.lexical_store(spark, str(tmp_path)).exists()
    tables.lexical_index(spark, str(tmp_path))
    assert rows() == before and tables.lexical_store(spark, str(tmp_path)).exists()


def test_statistics_of_terms_build_no_index(spark, tmp_path):
    """corpus_statistics by one pass over the texts and by the stored index, with empty, missing and no texts at all."""
    from tessera.plans import search, tables

    for name, held in {"some": [(3, "b a b AC-2(1) c b"), (5, "b ac-2(1)."), (6, ""), (7, None), (8, "... !")], "blank": [(1, None), (2, "")], "none": []}.items():
        folder = str(tmp_path / name)
        spark.createDataFrame(held, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        found = search.corpus_statistics(spark, folder)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and not tables.lexical_store(spark, folder).exists()
        got = [tuple(r) for r in found.collect()]
        assert got == {"some": [(5, 1.6, 4, 2)], "blank": [(2, 1.0, 0, None)], "none": [(0, 1.0, 0, None)]}[name]
        tables.lexical_index(spark, folder)
        stored = search.corpus_statistics(spark, folder)
        assert [tuple(r) for r in stored.collect()] == got and stored.dtypes == found.dtypes


def test_vectors_by_blocks_build_no_index(spark, tmp_path):
    """Those of all postings, over several blocks, with texts without tokens, in several parts of the table and of none; the query's SQL too."""
    from tessera.operators.lexical_vectors import document_vectors
    from tessera.plans import search, tables
    from tests.compare import same

    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["ac-2", "ac-2(1).", "Ünder", "log"]
    held = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 30, 200])))) for k in range(90)] + [(200, None), (201, ""), (202, "... !"), (203, "log " * 50)]
    docs = spark.createDataFrame(held, "doc_id long, text string").repartition(5)
    want = {}
    for r in lexical.document_vectors(lexical.term_weights(docs)).collect():
        want.setdefault(r.doc_id, {})[r.dim] = pytest.approx(r.w, rel=1e-12)
    got = {r.doc_id: [tuple(e) for e in r.vector] for r in document_vectors(docs).collect()}
    assert all(v == sorted(v) for v in got.values()) and {k for k, v in got.items() if not v} == {200, 201, 202}
    assert {k: dict(v) for k, v in got.items() if v} == want
    assert document_vectors(docs.limit(0)).count() == 0 and [r.vector for r in document_vectors(docs.filter("doc_id = 201")).collect()] == [[]]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(held, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    for folder in (str(tmp_path), f"{tmp_path}/one"):
        found = sorted(tuple(r) for r in search.bm25_doc_weights(spark, folder).collect())
        assert len(found) == 91 and not tables.lexical_store(spark, folder).exists()
        assert found[-1][:2] == (203, 1)
    assert same(spark, "/root/testdata/sf0.001", search.bm25_doc_weights, search.ORACLES["bm25_doc_weights"]) > 50


def test_blocks_hold_every_row_once(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from tessera.operators import lexical_vectors as v

    monkeypatch.setattr(v, "BLOCK", 10)
    sizes = [3, 0, 7, 1, 25, 4, 0, 0, 9, 2, 2]
    rows = pa.record_batch([pa.array(range(len(sizes))), pa.array([["x"] * n for n in sizes], pa.list_(pa.string()))], ["key", "tokens"])
    for cuts in ([11], [4, 7], [1] * 11, [0, 5, 6, 0]):
        starts = np.cumsum([0, *cuts])
        blocks = [b.column("key").to_pylist() for b in v._blocks(rows.slice(int(a), n) for a, n in zip(starts, cuts))]
        assert [k for b in blocks for k in b] == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in b) <= 10 or sum(sizes[k] for k in b[:-1]) < 10 for b in blocks) and len(blocks) >= 4
    assert list(v._blocks(iter([]))) == []


def test_parts_are_dealt_before_their_tokens_are_taken(spark, tmp_path):
    from tessera.plans import search

    spark.createDataFrame([(1, "red", "tin"), (1, "red", None), (2, "blue", "tin")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = search.dimension_literals(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    vectors = {r.p_partkey: r.vector for r in found.collect()}
    assert sorted(x.split(":")[1] for x in vectors[1][1:-9].split(",")) == ["2.0"] * 4 and len(vectors) == 2
