import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import resampling as r
from tests.compare import same


def grams(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return w, [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def plain(rows, target, percent=r.PERCENT, least=r.LEAST_WORDS):
    bucket = lambda f: crc32(f.encode()) % r.BUCKETS
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + r.BUCKETS) / ((s[b] + 1) * (nt + r.BUCKETS))))
    out = []
    for doc, text in rows:
        w, f = grams(text)
        weight = sum(gain(bucket(x)) for x in f)
        h = int(sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(enough[: percent * len(enough) // 100]):
        x[5] = k + 1
    return sorted(map(tuple, out), key=str)


def drawn(spark, rows, target, **options):
    docs = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], "doc_id long, text string, line string, weight long, rank string").repartition(3)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(x) for x in r.resample(docs, aim, **options).collect()), key=str)


def test_equals_plain(spark):
    g = np.random.default_rng(5)
    line = lambda: " ".join(f"W{int(x)}" for x in g.zipf(1.5, g.integers(0, 9)))
    lines = [line() for _ in range(30)] + ["", "one", "!!", "a-b", "Ünï cöde", "é" * 80 + " " + "z" * 200]
    rows = [(k, "\n".join(g.choice(lines, g.integers(0, 12)))) for k in range(150)]
    rows += [(3, rows[3][1]), (3, "another text under the same id " * 5), (None, "w1 w2 " * 20), (None, "w1 w2 " * 20), (900, None), (901, ""), (902, "\n\n"), (903, "long " * 50_000), (904, "a\n\nb\nc\n" * 9)]
    target = ["w1 w2 w3 w1", None, "one\nw1", "Ünï cöde"]
    for options in ({}, {"percent": 60, "least_words": 2}):
        assert drawn(spark, rows, target, **options) == plain(rows, target, *options.values())


def test_empty_tables(spark):
    assert drawn(spark, [], ["a b"]) == []
    rows = [(1, "a b c"), (2, None)]
    assert drawn(spark, rows, []) == plain(rows, [])


def test_lines_are_hashed_once_however_often_they_occur(spark):
    docs = r.valid(spark.createDataFrame([(k, "the same line\nand this\n\nthe same line") for k in range(40)], "doc_id long, text string"))
    assert {tuple(x) for x in r.distinct_lines(docs).collect()} == {("the same line", 80), ("and this", 40)}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400))
def test_moved_sums(a, b):
    assert int(r.moved(np.array([crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ crc32(b) == crc32(a + b)


def test_moved_far():
    for n in (63, 64, 65, 4096, 1_000_003):
        assert int(r.moved(np.array([crc32(b"x")], np.uint32), np.array([n]))[0]) ^ crc32(bytes(n)) == crc32(b"x" + bytes(n))


def test_query_matches_its_sql(spark, sf_dir):
    same(spark, sf_dir, r.QUERIES["op11_importance_resampling"], r.ORACLES["op11_importance_resampling"])
