import random

import numpy as np

from tessera.llm import near_dedup as nd


def brute(docs, size, similarity=80):
    """Component of each row of (doc_id, text), as the row's least linked doc_id."""
    sets = []
    for _, text in docs:
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= similarity * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    groups = {}
    for x in range(len(docs)):
        groups.setdefault(find(x), []).append(docs[x][0])
    return [min((d for d in groups[find(x)] if d is not None), default=None) for x in range(len(docs))], [len(s) for s in sets]


def check(spark, docs, size):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nd.with_component_ids(nd.near_duplicates(df, size)).collect()), key=repr)
    comps, sizes = brute(docs, size)
    assert got == sorted(((d, n, c) for (d, _), n, c in zip(docs, sizes, comps)), key=repr)


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in nd.op2_near_dedup(spark, sf_dir).collect()}
    comps, sizes = brute(docs, 2)
    assert all((rows[d].component_id, rows[d].n_shingles, rows[d].kept) == (c, n, d == c) for (d, _), c, n in zip(docs, comps, sizes))


def test_groups_of_near_copies_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng, docs = random.Random(3), []
    words = [f"w{k}" for k in range(3000)]
    for group in range(4):
        base = rng.sample(words, 60 + 10 * group)
        for copy in range(25):
            text = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((100 * group + copy, " ".join(text)))
    docs += [(1000 + k, " ".join(rng.sample(words, 40))) for k in range(20)]
    check(spark, docs, 2)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c d e"), (6, "a b c d e"), (7, "A b c d e"), (None, "a b c d e"), (None, "z y x"), (8, "word " * 5000), (9, "é É"), (10, "É é")]
    check(spark, docs, 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert nd.with_component_ids(nd.near_duplicates(df.limit(0))).count() == 0
    kept = sorted(((r.doc_id, r.text) for r in nd.keep_one(df, 2).collect()), key=repr)
    assert kept == sorted([(1, None), (2, ""), (3, " \n\t"), (4, "one"), (6, "a b c d e"), (None, "z y x"), (8, "word " * 5000), (9, "é É"), (10, "É é")], key=repr)


def test_estimates_are_near(spark):
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    for shared in (300, 600, 900):
        a, b = np.unique(np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])), np.unique(np.concatenate([pool[:shared], pool[2000 : 3000 - shared]]))
        agree = (nd.registers(a) == nd.registers(b)).mean()
        true = shared / (2000 - shared)
        assert abs((agree - nd.BY_CHANCE) / (1 - nd.BY_CHANCE) - true) < 0.15


def test_very_long_and_invalid_texts(spark):
    bad = spark.sql("select id as doc_id, cast(X'61ff622063206420' as string) as text from range(2)")
    words = " ".join(f"w{k}" for k in range(60_000))
    long = spark.createDataFrame([(10, words), (11, words.replace("w77 ", "other "))], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.with_component_ids(nd.near_duplicates(bad.unionByName(long), 2)).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 10: (59_999, 10), 11: (59_999, 10)}
