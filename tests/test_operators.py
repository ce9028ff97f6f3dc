import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import citations, text, tokens
from tessera.operators import dense, evaluation, fusion, mapping, retrieval, state, status, tree


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("risk-based approach", ["risk", "based", "approach"]), ("Req 8.3.6", ["req", "8.3.6"]), ("See AC-2.", ["see", "ac-2"]), ("A&A-01", ["a&a-01"]), ("(AC-2)", ["(ac-2)"]), ("", []), (None, [])],
)
def test_tokens(spark, text, want):
    assert one(spark, tokens.tokens(F.lit(text).cast("string"))) == want


def test_dimension_of_a_term(spark):
    assert one(spark, tokens.dimension(F.lit("ac-2"))) == 756039


@given(st.text(alphabet="abz019.-&( é", max_size=30))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_tokens_against_plain_python(spark, s):
    import re

    want = []
    for run in re.findall(r"[\w.()&-]+", s.lower()):
        letter, digit, dot = re.search(r"[^\W\d_]", run), re.search(r"\d", run), "." in run
        whole = (letter and (digit or dot)) or (digit and dot)
        want += filter(None, [run.rstrip(".")]) if whole else re.findall(r"[^\W_]+", run)
    assert one(spark, tokens.tokens(F.lit(s))) == want


@pytest.mark.parametrize("raw,want", [("AC-2(3)", "AC-02(03)"), ("AC-2(13)", "AC-02(13)"), ("AC-12", "AC-12")])
def test_zero_pad(spark, raw, want):
    assert one(spark, citations.zero_pad(F.lit(raw))) == want


def test_citations(spark):
    assert one(spark, citations.clean_citation(F.lit("AC - 2.3"))) == "AC-2(3)"
    assert one(spark, citations.clean_citation(F.lit("8.3.6"))) == "8.3.6"
    found = one(spark, citations.match_citations(F.lit("ac-2(3), AC-2(3) and pr.aa-01")))
    assert ("oscal-catalog", "AC-2(3)") in [tuple(m) for m in found] and ("csf-workbook", "PR.AA-01") in [tuple(m) for m in found]
    assert one(spark, citations.match_citations(F.lit("AC-2"), "unknown")) == []
    assert one(spark, citations.iso_reference(F.lit("2022: Annex A Controls: 5.1"))) == "A.5.1" and one(spark, citations.iso_reference(F.lit("2022: Annex A Controls 5.1"))) is None
    assert one(spark, citations.iso_reference(F.lit("2022: Mandatory Clause: 4.1"))) == "4.1"
    assert one(spark, citations.iso_reference(F.lit("2022: none"))) is None and one(spark, citations.iso_reference(F.lit("2013: 4.1"))) is None
    assert one(spark, citations.sp80053_target(F.lit("ac-2(3)"))) == "AC-02(03)"
    assert one(spark, citations.dotted_parent(F.lit("CLD.6.3"))) is None and one(spark, citations.dotted_parent(F.lit("8.3.6"))) == "8.3"
    assert one(spark, citations.cite_string(F.lit("A.5"), F.lit("fw"), F.lit(""))) == "A.5, fw"


def test_texts(spark):
    assert one(spark, text.labelled_body(F.lit("d"), [("A", F.lit("True")), ("B", F.lit(""))])) == "d\n\nA: Yes"
    assert one(spark, text.withdrawal_targets(F.lit("Incorporated into PR.AA-01, PR.AA-02"))) == ["PR.AA-01", "PR.AA-02"]
    assert one(spark, text.withdrawal_targets(F.lit("Moved into other material"))) == []
    assert one(spark, text.preview(F.lit("abcdef"), 3)) == "abc…"
    assert one(spark, text.same_model(F.lit("Org/Model-1"), F.lit("model-1"))) is True
    assert one(spark, dense.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) is None


def test_fusion(spark):
    arm = lambda ids: spark.createDataFrame([(c, k + 1) for k, c in enumerate(ids)], "chunk_id long, rank int")
    rows = fusion.fuse(arm([1, 2, 3]), arm([2, 4, 1]), rrf_k=60, weight=1.0).collect()
    assert rows[0].chunk_id == 2 and abs(rows[0].score - (1 / 62 + 1 / 61)) < 1e-8
    tie = fusion.fuse(arm([7]), arm([5]), rrf_k=60, weight=1.0).collect()
    assert [r.chunk_id for r in tie] == [5, 7]
    hits = spark.createDataFrame([(k, k + 1, g) for k, g in enumerate("aaab")], "chunk_id long, rank int, g string")
    assert [r.chunk_id for r in fusion.cap_per_group(hits, "g", 1, 3).orderBy("rank").collect()] == [0, 3, 1]
    pinned = fusion.merge_pinned(arm([9, 2]), arm([1, 2, 3]), "chunk_id", 3).orderBy("rank").collect()
    assert [r.chunk_id for r in pinned] == [9, 2, 1]


def test_resolution(spark):
    docs = spark.createDataFrame([(1, "iso27001", "2022", "main"), (2, "iso27001", "2022", "amendment"), (3, "fw", "v2", "main")], "id long, framework_code string, version_label string, doc_role string")
    controls = spark.createDataFrame([(10, 1, "5.1", "clause"), (11, 1, "A.5.1", "annex-control"), (12, 1, "A.5.2", "annex-control"), (13, 2, "5.1", "clause"), (14, 3, "X-1", "control")], "id long, document_id long, citation_norm string, kind string")
    versions = spark.createDataFrame([("iso27001", "2022", True), ("fw", "v2", True), ("none", "v1", False)], "framework_code string, version_label string, is_current boolean")
    relations = spark.createDataFrame([("fw", "v2", "fw", "v1", "supersedes"), ("fw", "v1", "fw", "v0", "supersedes")], "from_framework_code string, from_version_label string, to_framework_code string, to_version_label string, relation_type string")
    edges = spark.createDataFrame(
        [(1, "iso27001", None, "5.1"), (2, "iso27001", None, "5.2"), (3, "fw", "v1", "X-1"), (4, "fw", "v0", "X-1"), (5, "none", None, "1")],
        "from_control_id long, to_framework_code string, to_version_label string, to_citation_norm string",
    ).withColumn("provenance_detail", F.lit("row 1"))
    got = {r.from_control_id: r for r in mapping.resolve(edges, controls, docs, versions, relations).collect()}
    assert (got[1].to_control_id, got[1].resolved_by) == (10, "standard")
    assert (got[2].to_control_id, got[2].resolved_by) == (12, "annex-prefix") and got[2].provenance_detail.startswith("row 1; annex-prefix")
    assert (got[3].to_control_id, got[3].resolved_by) == (14, "supersession")
    assert got[4].to_control_id is None and got[5].to_control_id is None
    again = mapping.resolve(edges, controls, docs, versions, relations).select("from_control_id", "to_control_id").collect()
    assert sorted((r[0], r[1] or 0) for r in again) == sorted((k, r.to_control_id or 0) for k, r in got.items())


def test_tree(spark):
    rows = spark.createDataFrame([(1, None, "A"), (2, 1, "B"), (3, 2, "C"), (4, 99, "D")], "id long, parent_id long, citation string")
    paths = {r.id: r.path for r in tree.ancestors(rows).collect()}
    assert paths == {1: [], 2: ["A"], 3: ["A", "B"], 4: []}


def test_state(spark):
    schema = "rel_path string, sha256 string, status string, extracted_at timestamp, normalized_at timestamp, indexed_at timestamp"
    from datetime import datetime

    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "1", "active", t, t, t), ("b", "1", "active", t, None, None), ("c", "1", "active", None, None, None)], schema)
    scan = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "rel_path string, sha256 string")
    got = {r.rel_path: r for r in state.upsert_manifest(old, scan).collect()}
    assert got["a"].indexed_at == t and got["b"].extracted_at is None and got["c"].status == "removed" and got["d"].status == "active"
    empty = state.upsert_manifest(old, scan.limit(0)).collect()
    assert {r.status for r in empty} == {"active"}


def test_globs(spark):
    fits = [("docs/*.pdf", "docs/a.pdf"), ("docs/**.pdf", "docs/a.pdf"), ("a[b-d]e", "ace"), ("a[^b-d]e", "axe"), ("a[^b]c", "a/c"), (r"a\\*b", "a*b"), ("?.x", "é.x"), ("a]b", "a]b"), (r"[\\]a-]", "]") , ("*", "")]
    misses = [("docs/*.pdf", "docs/x/a.pdf"), ("docs/**.pdf", "docs/x/a.pdf"), ("a[b-d]e", "aee"), ("[]a]", "a"), ("[a", "a"), ("[a-]", "a"), ("a\\\\", "a"), ("?", "/"), ("a.b", "axb"), ("*", "\\n/")]
    fits = [(p.replace("\\\\", "\\"), x.replace("\\\\", "\\")) for p, x in fits if p != r"[\\]a-]"]
    for ok, cases in ((True, fits), (False, misses)):
        for pattern, path in cases:
            files = spark.createDataFrame([(path, 1)], "rel_path string, name int")
            got = state.match_rules(files, [{"pattern": pattern, "identity": "yes"}]).first().identity
            assert (got == "yes") == ok, (pattern, path)
    files = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "rel_path string, n int")
    got = state.match_rules(files, [{"pattern": "[", "identity": "bad"}, {"pattern": "?", "identity": "one"}, {"pattern": "a", "identity": "late"}]).collect()
    assert sorted((r.rel_path or "", r.identity or "") for r in got) == [("", ""), ("a", "one"), ("a", "one")]
    assert state.match_rules(files, []).count() == 3


def test_tokens_by_runs(spark):
    """tokens() against the rule for each run, on random texts."""
    import random
    import re

    rng = random.Random(6)
    texts = ["".join(rng.choices("aB1.é-()& ٣,\n中x2", k=rng.randint(0, 40))) for _ in range(400)]

    def plain(text):
        out = []
        for run in re.findall(r"[^\W_.()&-]+(?:[.()&-]|[^\W_])*|[.()&-](?:[.()&-]|[^\W_])*", text.lower()):
            letter, digit, dot = any(c.isalpha() for c in run), any(c.isdigit() for c in run), "." in run
            if letter and (digit or dot) or digit and dot:
                out += [run.rstrip(".")] if run.rstrip(".") else []
            else:
                out += re.findall(r"[^\W_]+", run)
        return out

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", tokens.tokens(F.col("t")).alias("found")).collect()
    for r in rows:
        assert r.found == plain(texts[r.k]), texts[r.k]


def test_evaluation(spark):
    cases = spark.createDataFrame([("p", False, False), ("q", True, False), ("r", False, True)], "case_id string, expect_abstain boolean, expect_fail boolean")
    expected = spark.createDataFrame([("p", "F", "v1", "X"), ("p", "F", "v1", "Y")], "case_id string, framework_code string, version_label string, citation_norm string")
    hits = spark.createDataFrame([("p", 1, "f", "v2", "z", True), ("p", 2, "f", "V1", "x", False), ("p", 3, "g", "v0", "z", False)], "case_id string, rank int, framework_code string, version_label string, citation_norm string, is_current boolean")
    got = {r.case_id: r for r in evaluation.case_metrics(cases, expected, hits).collect()}
    assert (got["p"].found, got["p"].want, got["p"].reciprocal_rank, got["p"].ok, got["p"].returned) == (1, 2, 0.5, 2, 2)
    assert got["q"].abstain_ok
    total = evaluation.summary(evaluation.case_metrics(cases, expected, hits)).first()
    assert (total.cases, total.recall, total.mrr, total.current, total.abstain) == (2, 0.5, 0.5, 1.0, 1.0)


def test_search_pins_and_options(spark):
    chunk = spark.createDataFrame([(1, "fw", "v1", True, "active", "access control ac-02 account", "AC-02", 0), (2, "fw", "v1", True, "active", "account review", "AC-03", 1), (3, "fw", "v0", False, "active", "account old", "AC-02", 0), (4, "fw", "v1", True, "withdrawn", "account gone", "AC-09", 2)], "chunk_id long, framework_code string, version_label string, is_current boolean, status string, content string, citation_norm string, ordinal int")
    hits = retrieval.search(chunk, None, "AC-02 account").collect()
    assert hits[0].chunk_id == 1 and hits[0].score == 1.0 and 4 not in [h.chunk_id for h in hits]
    old = retrieval.search(chunk, None, "account").collect()
    assert [h.chunk_id for h in old][-1] == 3
    with pytest.raises(ValueError):
        retrieval.search(chunk, None, "x", o=retrieval.Options(mode="vector"))
    assert status.clamp_limit(0, 5, 10) == 5 and status.clamp_limit(99, 5, 10) == 10
    assert [g["kind"] for g in retrieval.gaps(0, "nope", "", {"fw": ["v1"]})] == ["unknown_framework", "no_evidence"]


def test_lanes_pool_and_titles(spark):
    cases = spark.createDataFrame([("p", False, False)], "case_id string, expect_abstain boolean, expect_fail boolean")
    expected = spark.createDataFrame([("p", "F", "v1", "X")], "case_id string, framework_code string, version_label string, citation_norm string")
    hit = lambda norm: spark.createDataFrame([("p", 1, "f", "v1", norm, True)], "case_id string, rank int, framework_code string, version_label string, citation_norm string, is_current boolean")
    got = evaluation.lanes(cases, expected, hit("y"), hit("x"))
    assert got["open"].first().recall == 0 and got["pinned"].first().recall == 1
    assert {r.metric for r in got["gate"].collect()} == {"recall", "mrr"}
    assert evaluation.pool_recall(expected, hit("x")).first().recall == 1.0
    assert evaluation.report([{"a": 1, "b": "xy"}], ["a", "b"]) == "a  b\n1  xy"
    controls = spark.createDataFrame([(1, "A", "own"), (2, "B", "own")], "id long, citation_norm string, title string")
    titles = spark.createDataFrame([("fw", "v1", "A", "ours"), ("fw", "v2", "B", "not this")], "framework_code string, version_label string, citation_norm string, title string")
    assert {(r.id, r.title) for r in tree.curated_titles(controls, titles, "fw", "v1").collect()} == {(1, "ours"), (2, "own")}


def test_listings_and_reports(spark):
    rows = spark.createDataFrame([("b", False), ("a", True), ("c", True)], "prefix string, enabled boolean")
    assert [r.prefix for r in status.listed("reference_sources", rows).collect()] == ["a", "c"] and status.listed("reference_sources", rows, prefix="c").count() == 1
    with pytest.raises(ValueError):
        status.listed("everything", rows)
    lines = [{"case_id": "one", "recall": "1/2"}, {"case_id": "second", "recall": "0/1"}]
    assert evaluation.report(lines, ["case_id", "recall"]).split("\n") == ["case_id  recall", "one      1/2", "second   0/1"]
    assert evaluation.report_json({"top_k": 8}, lines, {"recall": 0.5}) == {"schema_version": 1, "top_k": 8, "aggregate": {"recall": 0.5}, "cases": lines}


def test_options_fall_back_to_their_defaults():
    o = retrieval.Options(top_k=0, vector_k=-3, lexical_weight=0, doc_cap=-1)
    assert (o.top_k, o.vector_k, o.bm25_k, o.rrf_k, o.lexical_weight, o.doc_cap) == (8, 50, 50, 20, 0.5, 0)
    assert retrieval.Options().shows_older and not any(retrieval.Options(**k).shows_older for k in ({"framework": "f"}, {"version": "v"}, {"current_only": True}, {"current_only": False}))
    with pytest.raises(ValueError):
        retrieval.Options(mode="fuzzy")
