import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import vector_codes as v
from tests.compare import same


def plain(rows, parts, entries, rounds):
    """id, codes, error of the rows that are kept, in their order, and the codebooks, by comparing all."""
    sound = [(k, e) for k, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not sound:
        return [], []
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0))
    size = len(sound[0][1])
    if not size or size % parts:
        return [], []
    wide = size // parts
    held = [(k, [math.floor(256 * x) for x in e]) for k, e in sound if len(e) == size]
    cut = lambda e, p: e[p * wide : (p + 1) * wide]
    books = [[cut(e, p) for _, e in held[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, e in held:
                groups[near(cut(e, p), book)[1]].append(cut(e, p))
            for i, own in groups.items():
                book[i] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for k, e in held:
        found = [near(cut(e, p), books[p]) for p in range(parts)]
        out.append((k, [i for _, i in found], sum(d for d, _ in found)))
    return out, books


def coded(spark, rows, **options):
    table = spark.createDataFrame([(k, e, "x", 5, 1.0) for k, e in rows], "vec_id long, embedding array<float>, codes string, error int, vector double").repartition(3)
    found, books = v.encode(table, **options)
    return sorted(((r.vec_id, r.codes, r.error) for r in found.collect()), key=str), [b.tolist() for b in books]


@pytest.mark.parametrize("entries,rounds", [(4, 2), (8, 0), (64, 1)])
def test_equals_plain(spark, entries, rounds):
    g = np.random.default_rng(entries)
    rows = [(int(k), [float(x) for x in np.float32(g.normal(size=8) / 3)]) for k in g.permutation(120)]
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(None, rows[0][1]), (300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, [1.0] * 4), (305, [])]
    want, books = plain(rows, 4, entries, rounds)
    got, found = coded(spark, rows, parts=4, entries=entries, rounds=rounds)
    assert got == sorted(want, key=str) and found == books


def test_edges(spark):
    assert coded(spark, []) == ([], [])
    assert coded(spark, [(1, [0.5] * 6)], parts=4) == ([], [])  # no multiple of the parts
    assert coded(spark, [(1, []), (2, [1.0] * 16)]) == ([], [])
    got, books = coded(spark, [(1, [0.0] * 16), (1, [0.0] * 16), (2, [3e38] * 16)])
    assert [r[1] for r in got] == [[0] * 16, [0] * 16, [2] * 16] and books[0][2] == [v.MOST]
    assert v.digest([np.array([[1, 2], [3, 4]]), np.array([[-5, 6]])]) == hashlib.sha256(b"1,2,3,4,-5,6").hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.data())
def test_nearest_equals_all_pairs(dim, data):
    rows = st.lists(st.lists(st.integers(-6, 6), min_size=dim, max_size=dim), min_size=1, max_size=30)
    x, book = np.array(data.draw(rows)), np.array(data.draw(rows))
    far = ((x[:, None] - book[None]) ** 2).sum(2)
    index, best = v.nearest(x, book)
    assert index.tolist() == far.argmin(1).tolist() and best.tolist() == far.min(1).tolist()


def test_query_matches_its_sql(spark, sf_dir):
    same(spark, sf_dir, v.QUERIES["op13_vector_codes"], v.ORACLES["op13_vector_codes"])
