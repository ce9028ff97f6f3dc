import pytest
from pyspark.sql import functions as F

from tessera import api
from tessera.operators import embedding
from tessera.sources import files


@pytest.fixture(scope="module")
def corpus(spark):
    make = spark.createDataFrame
    return {
        "frameworks": make([("fw", "Framework", "open"), ("gw", "Other", "open")], "code string, name string, serve_policy string"),
        "versions": make([("fw", "v2", True, "second"), ("fw", "v1", False, "first"), ("gw", "v1", True, "only")], "framework_code string, version_label string, is_current boolean, edition_note string"),
        "documents": make([(1, "fw", "v2", "main", "", "fw|v2|main"), (2, "fw", "v1", "main", "", "fw|v1|main"), (3, "fw", "v2", "amendment", "a1", "fw|v2|amendment:a1"), (4, "gw", "v1", "main", "", "gw|v1|main")], "id long, framework_code string, version_label string, doc_role string, qualifier string, doc_key string"),
        "controls": make(
            [(10, 1, None, "AC", "AC", "family", "active", "Access", None, None, None, 0), (11, 1, 10, "AC-02", "AC-02", "control", "active", "Accounts", "Keep them.", None, None, 1), (12, 2, None, "AC-02", "AC-02", "control", "active", "Old", None, None, None, 0), (13, 3, None, "patch", "PATCH", "clause", "active", "P", "new text", "AC-02", "replace", 0), (14, 4, None, "AC-02", "AC-02", "control", "withdrawn", "Their", "A much longer body of theirs.", None, None, 0), (15, 4, None, "GX-1", "GX-1", "control", "active", "X", None, None, None, 1)],
            "id long, document_id long, parent_id long, citation string, citation_norm string, kind string, status string, title string, body string, amends_citation_norm string, amend_action string, ordinal int",
        ),
        "edges": make([(11, 14, "gw", "v1", "AC-02", "src"), (11, None, "zz", None, "Q-1", "src"), (14, 11, "fw", None, "AC-02", "src")], "from_control_id long, to_control_id long, to_framework_code string, to_version_label string, to_citation_norm string, mapping_source_code string"),
        "relations": make([("fw", "v2", "fw", "v1", "supersedes", "n")], "from_framework_code string, from_version_label string, to_framework_code string, to_version_label string, relation_type string, note string"),
        "chunks": make([(100, 11, "c", 0), (101, 11, "d", 1), (102, 12, "e", 0)], "id long, control_id long, content string, ordinal int"),
        "embeddings": make([(100, "m")], "chunk_id long, model string"),
        "manifest": make([("a", "1", "fw", "v2", "main", None, False, None), ("b", None, None, None, None, None, False, None), ("c", "2", "fw", "v9", "amendment", "", False, "")], "rel_path string, sha256 string, framework_code string, version_label string, doc_role string, qualifier string, ignored boolean, stage_error string"),
    }


def test_dossiers_of_many(spark, corpus):
    asked = [(1, "ac-2", "", ""), (2, "AC-2", "fw", "v7"), (3, "GX-1", "", ""), (4, "AC-2", "fw", "v1"), (5, "none", "fw", ""), (6, "GX-1", "fw", ""), (7, "AC", None, None), (8, None, "", "")]
    rows = {r.query_id: r for r in api.dossiers(corpus, spark.createDataFrame(asked, "query_id long, citation string, framework string, version string"), limit=1).collect()}
    assert len(rows) == len(asked)
    for k, citation, framework, version in asked[:7]:
        one, r = api.document(corpus, citation, framework or "", version or "", limit=1), rows[k]
        assert r.found == one["found"] and [g.kind for g in r.gaps] == [g["kind"] for g in one["gaps"]], k
        assert [list(g.found_in or []) for g in r.gaps] == [g.get("found_in", []) for g in one["gaps"]]
        if not r.found:
            continue
        assert r.control.id == one["control"]["id"] and r.more_chunks == (one["next_offset"] is not None)
        assert [c.id for c in r.children or []] == [c.id for c in one["children"].collect()] and [c.chunk_id for c in r.chunks or []] == [c.id for c in one["chunks"].collect()]
        assert sorted((e.to_citation_norm, e.resolved, e.resolved_title) for e in r.outbound or []) == sorted((e.to_citation_norm, e.resolved, e.resolved_title) for e in one["outbound"].collect())
        assert r.n_inbound == one["inbound"].count() and [(x.kind, x.version_label) for x in r.lineage] == [(x.kind, x.version_label) for x in one["lineage"].orderBy("block", "kind", "version_label").collect()]
        assert [a.citation for a in r.amendments or []] == [a.citation for a in one["amendments"].collect()]
    assert not rows[8].found


def test_document(corpus):
    got = api.document(corpus, "ac-2", limit=1)
    assert got["found"] and got["control"]["id"] == 11 and [g["kind"] for g in got["gaps"]] == ["ambiguous_citation"]
    assert got["next_offset"] == 1 and got["chunks"].count() == 1 and got["amendments"].first()["action"] == "replace"
    assert got["parent"].first()["citation"] == "AC" and got["outbound"].filter("resolved").count() == 1 and got["inbound"].first()["from_citation"] == "AC-02"
    assert [(r.kind, r.version_label) for r in got["lineage"].orderBy("block", "version_label").collect()] == [("from", "v1"), ("version", "v1"), ("version", "v2")]
    gone = api.document(corpus, "AC-2", framework="fw", version="v7")
    assert not gone["found"] and [g["kind"] for g in gone["gaps"]] == ["no_evidence", "version_not_found", "found_elsewhere"]
    assert "no_chunks" in [g["kind"] for g in api.document(corpus, "GX-1")["gaps"]]
    with pytest.raises(ValueError):
        api.document(corpus, "AC-2", include=["all"])


def test_status_and_gaps(corpus):
    got = api.corpus_status(corpus)
    rows = {(r.framework_code, r.version_label): r for r in got["frameworks"].collect()}
    assert rows["fw", "v2"].controls == 3 and rows["fw", "v2"].chunks == 2 and rows["fw", "v2"].inbound_edges == 1 and rows["gw", "v1"].withdrawn == 1
    assert got["totals"]["unresolved"] == 1 and got["search_ready"] and len(got["notes"]) == 2
    gaps = api.quality_gaps(corpus)
    assert gaps["unresolved_mappings"].first()["to_framework_code"] == "zz" and gaps["deferred_docs"].first()["reason"] == "amendment parsing deferred"
    assert [r.rel_path for r in gaps["manifest"].collect()] == ["b"]
    with pytest.raises(ValueError):
        api.quality_gaps(corpus, "nothing")


def test_chunks_and_embeddings(spark, corpus):
    edges = corpus["edges"].filter("to_control_id is not null").select(F.col("from_control_id").alias("from_id"), F.col("to_control_id").alias("to_id"))
    built = embedding.build_chunks(corpus["controls"], corpus["documents"], edges)
    row = built.filter("control_id = 11").first()
    assert row.context_prefix == "fw v2 > AC > Accounts" and row.content == "AC-02 Accounts\nKeep them.\n\n[equivalent gw AC-02]\nA much longer body of theirs."
    none = spark.createDataFrame([], "chunk_id long, model string")
    vectors = embedding.embed_missing(built, none, "m", lambda: embedding.hash_embedder)
    assert vectors.count() == 6 and vectors.first()["dims"] == 64
    assert embedding.embed_missing(built, vectors, "m", lambda: embedding.hash_embedder).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("hello")
    assert [(r.rel_path, r.size_bytes) for r in files.scan(spark, str(tmp_path / "x")).collect()] == [("a.txt", 5)]
    head = "id,question,framework_code,version_label,citation_norm,expect_abstain,expect_fail,notes\n"
    (tmp_path / "g.csv").write_text(head + "1,q,fw,v1,A,,,\n1,other,fw,v1,B,true,,\n2,out,,,,true,,\n,noid,,,,,,\n3,aimless,,,,,,\n")
    cases, expected, rejected = files.read_golden(spark, str(tmp_path / "g.csv"))
    assert {(r.case_id, r.question, r.expect_abstain) for r in cases.collect()} == {("1", "q", False), ("2", "out", True), ("3", "aimless", False)}
    assert expected.count() == 2 and {r.why for r in rejected.collect()} == {"no id or question", "expects nothing"}
    (tmp_path / "v.json").write_text('{"index":1,"embedding":[1,2]}\n{"index":2,"embedding":[1]}\n{"index":3,"embedding":[1,2]}\n{"index":3,"embedding":[1,2]}\n')
    good, bad = files.read_vectors(spark, str(tmp_path / "v.json"), 2)
    assert [r["index"] for r in good.collect()] == [1] and {(r["index"], r.why) for r in bad.collect()} == {(2, "dimensions"), (3, "twice")}
