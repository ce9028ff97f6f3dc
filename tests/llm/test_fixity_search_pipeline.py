import corpus_pipeline
from tessera.llm import fixity, topk_search
from tests.compare import same
from tests.llm.test_packing import check


def test_fixity_matches_sql(spark, sf_dir):
    same(spark, "/root/testdata/sf0.01", fixity.op9_fixity, fixity.ORACLES["op9_fixity"])


def test_fixity_odd_rows(spark):
    schema = "page_id long, url string, html string"
    ours = [(1, "u", "a"), (1, "u", "b"), (2, None, None), (None, "u", "x"), (5000, "u", "é"), (-3, "u", "z"), (7, "u", "t" * 100000)]
    a = spark.createDataFrame(ours, schema)
    same_rows = spark.createDataFrame(ours[::-1], schema)
    got = fixity.verify(a, same_rows).collect()
    assert {r.status for r in got} == {"ok"} and len(got) == 6
    b = spark.createDataFrame([(1, "u", "a"), (1, "u", "c"), (2, "", ""), (5000, "u", "é"), (-3, "u", "z"), (8, "u", "new"), (7, "u", "t" * 100000)], schema)
    got = {r.page_id: r.status for r in fixity.verify(a, b).collect()}
    assert got == {1: "changed", 2: "ok", None: "missing", 5000: "ok", -3: "ok", 8: "extra", 7: "ok"}
    assert {r.status for r in fixity.verify(a, a.limit(0)).collect()} == {"missing"}
    assert fixity.verify(a.limit(0), a.limit(0)).count() == 0


def test_fixity_of_any_ids(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    schema = "page_id long, url string, html string, node long, digest string"
    for ids in ([least, -1, 0, None, most], [5 * 10**17, 5 * 10**17 + 1, None], [-70, -1]):
        rows = [(i, "u", f"body {i}", 1, "x") for i in ids]
        ours = spark.createDataFrame(rows, schema)
        theirs = spark.createDataFrame([(i, u, "bent" if k == 0 else h, n, d) for k, (i, u, h, n, d) in enumerate(rows)], schema)
        got = fixity.verify(ours, theirs).collect()
        assert {r.page_id: r.status for r in got} == {i: "changed" if k == 0 else "ok" for k, i in enumerate(ids)}
        placed = sorted(got, key=lambda r: (r.page_id is not None, r.page_id or 0))
        at = 0
        for r in placed:
            assert r.offset == at
            at += r.length
    far = spark.createDataFrame([(least, "u", "a"), (most, "u", "b"), (5 * 10**17, "u", "c")], "page_id long, url string, html string")
    assert fixity.damaged(far).count() >= 2


def test_search_matches_sql(spark, sf_dir):
    assert same(spark, sf_dir, topk_search.op3_topk_search, topk_search.ORACLES["op3_topk_search"]) > 0


def test_search_in_many_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    queries = docs.filter("doc_id % 20 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(topk_search.search(docs, queries, 5, shard_docs=17)) == rows(topk_search.search(docs, queries, 5))


def test_search_odd_rows(spark):
    docs = spark.createDataFrame([(0, "apple pear"), (0, "apple pear"), (1, "Apple"), (2, None), (20, ""), (None, "apple"), (3, "plum " * 5000 + "pear"), (40, None)], "doc_id long, text string")
    got = [tuple(r)[:3] for r in topk_search.search(docs, docs.filter(topk_search.is_query(docs.doc_id)), 10).orderBy("query_id", "rank").collect()]
    assert {q for q, *_ in got} == {0} and {d for *_, d in got} == {1, None, 3}
    assert topk_search.search(docs.limit(0), docs.limit(0)).count() == 0


def plain_search(docs, top):
    """The same over Python lists, from the definition."""
    import math
    from collections import Counter

    bags = [Counter(t.lower().split()) for _, t in docs]
    n, mean = len(docs), sum(sum(b.values()) for b in bags) / len(docs)
    df = Counter(w for b in bags for w in b)
    out = set()
    for (q, text), asked in {d: b for d, b in zip(docs, bags)}.items():
        if q is None or q % 20:
            continue
        found = []
        for (d, t), b in zip(docs, bags):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in asked if w in b)
            if (d, t) != (q, text) and round(s, 4) > 0:
                found.append((-round(s, 4), d is None, d or 0, d))
        out |= {(q, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])}
    return out


def test_search_with_ties_copies_and_frequent_words(spark, monkeypatch):
    import random

    rng = random.Random(4)
    pool = [f"w{k}" for k in range(200)]
    weights = [1 / (k + 1) for k in range(200)]
    docs = [(k, " ".join(rng.choices(pool, weights, k=rng.choice([3, 20, 80, 300])))) for k in range(500)]
    docs += [(d, docs[100][1]) for d in (700, 701, 702)] * 2 + [(700, docs[100][1])] * 20 + [(None, docs[40][1])] * 3  # more equal rows than are asked for
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, query int").repartition(3)
    want = plain_search(docs, 5)
    for first in (8, 1):
        monkeypatch.setattr(topk_search, "FIRST", first)
        got = topk_search.search(df, df.filter(topk_search.is_query(df.doc_id)), 5, shard_docs=150).collect()
        assert {(r.query_id, r.rank, r.doc_id) for r in got} == {x[:3] for x in want}
        assert {(r.query_id, r.rank): r.score for r in got} == {(q, k): s for q, k, _, s in want}


def test_search_looks_up_a_block_in_parts(spark, sf_dir, monkeypatch):
    """A block of queries is one pass over the shards, whatever part of it a shard looks up at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted(map(tuple, topk_search.search(docs, docs.filter("doc_id % 3 = 0"), 5).collect()))
    want = rows()
    passes = []
    hits = topk_search._hits
    monkeypatch.setattr(topk_search, "_hits", lambda *a: passes.append(1) or hits(*a))
    monkeypatch.setattr(topk_search, "LOOKED_UP", 700)
    assert rows() == want and len(passes) == 2


def test_search_scores_only_what_reaches_the_floor(spark, sf_dir, monkeypatch):
    """A query that no document of a shard can serve costs no scoring there; those at the floor or over it are all found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").coalesce(1)
    index = topk_search.build_index(docs)
    n, mean, df = topk_search.statistics(index)
    rows = topk_search.query_terms(docs.filter("doc_id % 3 = 0"), df, n).toArrow()
    shard = topk_search.Shard(index.first().asDict(), mean)
    ask = lambda floor: [(q, d, s) for q, at, scores in shard.search(topk_search.Queries(rows.append_column("floor", [[floor] * len(rows)])), 5) for d, s in zip(at.tolist(), scores.tolist())]
    every = ask(0.0)
    floor = sorted(s for *_, s in every)[len(every) * 3 // 4]
    scored, score = [], topk_search.Shard.score
    monkeypatch.setattr(topk_search.Shard, "score", lambda self, found, *a: scored.append(len(found)) or score(self, found, *a))
    assert {x for x in ask(floor) if x[2] >= floor} == {x for x in every if x[2] >= floor}
    assert scored and min(scored) > 0 and len(scored) < len(rows)


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            before = {r.doc_id: r.text for r in docs.collect()}
            rows = [r.asDict() for r in out.collect()]
            assert {r["doc_id"] for r in rows} <= set(before)
            docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    rows = out.collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline_against_plain_versions(spark, sf_dir):
    """Every stage but the last on what the one before kept, from the texts: which documents stay, and with what text."""
    from tessera.llm import line_dedup, quality_classifier
    from tests.llm.test_line_dedup import brute as plain_lines
    from tests.llm.test_near_dedup import brute as plain_groups
    from tests.llm.test_secrets import base

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    table = lambda texts: spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts.items()], docs.schema)

    field = quality_classifier.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_classifier.with_scores(docs, field).collect()}
    kept = rows(steps["quality classifier"](spark, docs, sf_dir))
    assert kept == {d: t for d, t in rows(docs).items() if scores[d] >= quality_classifier.THRESHOLD} and len(kept) < len(scores)

    found, want = rows(steps["line dedup"](spark, table(kept), sf_dir)), {}
    blank = " \t\n\r\v\f"
    numbered = {d: [(k, x.strip(blank)) for k, x in enumerate((t or "").split("\n")) if x.strip(blank)] for d, t in kept.items()}
    gone = plain_lines([(d, "\n".join(x for _, x in numbered[d])) for d in sorted(kept)], line_dedup.LEAST)
    for d, text in kept.items():
        out = {numbered[d][k][0] for k in gone[d] if numbered[d]}
        want[d] = text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out)
    assert found == want and found != kept

    once = rows(steps["MinHash near-dedup"](spark, table(found), sf_dir))
    listed = sorted(found.items())
    least, sizes = plain_groups(listed, 5)
    assert once == {d: t for (d, t), c, n in zip(listed, least, sizes) if not n or c == d} and len(once) < len(found)

    some = min(once)
    once |= {10**9: "password = abcdefgh99 stands here", 10**9 + 1: f"{once[some]} AKIA{'Q7' * 8} {'0f' * 20}"}
    clean = rows(steps["secret scans"](spark, table(once), sf_dir))
    assert set(clean) == set(once)
    changed = {d for d in once if clean[d] != once[d]}
    assert {d for d, t in once.items() if base(t or "")} <= changed and changed
    assert all(not base(clean[d]) and "[SECRET]" in clean[d] for d in changed)


def test_pipeline_runs(spark, sf_dir):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, an empty table, no labels, and the caller's own columns under the names that the operators use."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("n_removed", pa.string()), ("score", pa.float64()), ("component_id", pa.int64())])
    line = "a line of a good many words that stands in more than one text here " * 5
    texts = [None, "", "one", line, line, f"{line}\nand more\n{line}", "password = abcdefgh99 " + line]
    table = {"doc_id": [1, 2, 3, 4, 5, None, 6], "text": texts, "lang": [None] * 7, "source": ["s"] * 7, "n_chars": [0] * 7, "n_removed": ["mine"] * 7, "score": [0.5] * 7, "component_id": [9] * 7}
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())})
    for name, rows in (("some", 7), ("none", 0)):
        d = tmp_path / name
        d.mkdir()
        pq.write_table(pa.table(table, kinds).slice(0, rows), d / "documents.parquet")
        pq.write_table(labels, d / "labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = stage(spark, docs, str(d))
            assert docs.columns == kinds.names
            kept = docs.collect()
            assert all(r.n_removed == "mine" and r.score == 0.5 and r.component_id == 9 for r in kept)
            docs = spark.createDataFrame(kept, docs.schema)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
