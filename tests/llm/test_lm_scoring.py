import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import lm_scoring as lm


def tokens(text):
    return [*(text or "").encode().translate(lm._FOLD).split(), b"\n"]


def plain(rows, exact=False):
    """Scores of (id, text, held out) by dictionaries; exact: without quantised steps."""
    step = (lambda p: -math.log10(p) * lm.STEP) if exact else (lambda p: float(lm.quantised(np.array([math.log10(p)]))[0]))
    real = lambda q: 10 ** (-q / lm.STEP)
    counts = [Counter(), Counter(), Counter()]
    for _, text, held in rows:
        t = tokens(text)
        if not held:
            for n, c in enumerate(counts):
                c.update(tuple(t[k - n : k + 1]) for k in range(n, len(t)))
    one, two, three = counts
    n, v = sum(one.values()), len(one)
    out = []
    for doc, text, held in rows:
        t, total, base, known = tokens(text), 0.0, 0.0, 0
        for k, w in enumerate(t):
            p1 = (one[(w,)] + 1) / (n + v + 1)
            base += math.log10(p1)
            known += one[(w,)] > 0
            q = step(p1)
            if k:
                a = t[k - 1]
                c = one[(a,)]
                q2 = lambda w: step((two[(a, w)] + lm.BACK2 * real(step((one[(w,)] + 1) / (n + v + 1)))) / (c + lm.BACK2))  # noqa: E731, B023
                if c:
                    q = q2(w) if two[(a, w)] else q + step(lm.BACK2 / (c + lm.BACK2))
                if k > 1 and two[(t[k - 2], a)]:
                    c3 = two[(t[k - 2], a)]
                    n3 = three[(t[k - 2], a, w)]
                    q = step((n3 + lm.BACK3 * real(q2(w))) / (c3 + lm.BACK3)) if n3 else q + step(lm.BACK3 / (c3 + lm.BACK3))
            total += q
        out.append((doc, held, len(t), known, n, base, -total / lm.STEP))
    return out


def scored(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    return [tuple(r) for r in lm.score(docs, **sizes).collect()]


def same(got, want, wide=1e-9):
    key = lambda r: (r[0] is None, r[0] or 0, r[2:4], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], abs=wide), (g, w)


def made(n, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"W{int(x)}" for x in r.zipf(1.4, r.integers(0, 60)) if x < 400]
        if k % 3 == 0:
            words = [w for x in words for w in ("the", "Hot", x)]  # a pair in many documents, after and before any word
        rows.append((k, " ".join(words) + ("\n" if k % 2 else ""), crc32(str(k).encode()) % 7 == 2))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 2000, "shard": 3000, "hot": 0.2}, {"block": 500, "shard": 1000, "hot": 0.01}])
def test_scores_equal_plain_counts(spark, sizes):
    rows = made(120) + [(7, "The hot w1 w2", False), (7, "The hot w1 w2", False), (500, None, False), (501, "", True), (None, "the hot w1", False), (502, "never seen " * 300, True), (503, "x" * 100_000, False), (504, "the hot " * 4000, False)]
    same(scored(spark, rows, **sizes), plain(rows))
    for g, w in zip(sorted(scored(spark, rows[:60], **sizes)), sorted(plain(rows[:60], exact=True)), strict=True):
        assert abs(g[6] - w[6]) <= 1e-3 * g[2]


@pytest.mark.parametrize("seed", range(5))
def test_probabilities_after_any_words_sum_to_one(seed):
    r = np.random.default_rng(seed)
    one, two, three = r.integers(0, 5, 300), r.integers(1, 5, 300), r.integers(1, 9, 300)
    own = np.array([0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.03, 0.02])
    steps = np.concatenate([[0], lm.quantised(np.log10(own))]).astype(np.int64)
    zero = np.zeros(300, np.int64)
    trie = lm.Trie(one, two, three, steps[three], r.random(300) < 0.8, zero, zero, zero)
    every = np.arange(1, 10)
    for a in range(6):
        for b in range(1, 7):
            found = trie.steps(np.full(9, a), np.full(9, b), every, steps[every])
            assert (10.0 ** (-found / lm.STEP)).sum() == pytest.approx(1, abs=2e-3)


def test_no_training_texts_and_no_rows(spark):
    rows = [(1, "a b", True), (2, None, True)]
    same(scored(spark, rows), [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)])
    assert scored(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 34), max_size=1500), st.data())
def test_sequences(values, data):
    values = np.sort(np.array(values, np.int64))
    held = lm.Mapped(lm.Monotone.encode(values))
    seq = lm.Monotone(lambda k: held[k])
    i = data.draw(st.integers(0, len(values)))
    j = data.draw(st.integers(i, len(values)))
    assert seq.slice(i, j).tolist() == values[i:j].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 4), st.integers(1, 5), st.booleans()), min_size=1, max_size=200), st.integers(1, 9))
def test_trie_in_slices(rows, size):
    one, two, three, train = (np.array(x) for x in zip(*rows))
    zero = np.zeros(len(rows), np.int64)
    unigram = three * 1000
    trie = lm.Trie(one, two, three, unigram, train.astype(bool), zero, zero, zero)
    want = trie.steps(one, two, three, unigram)
    trie.SLICE = size
    assert trie.steps(one, two, three, unigram).tolist() == want.tolist()
    pairs, triples = Counter((b, c) for _, b, c, t in rows if t), Counter((a, b, c) for a, b, c, t in rows if t and a)
    firsts, befores = Counter(b for _, b, _, t in rows if t), Counter((a, b) for a, b, _, t in rows if t and a)
    for a, b, c, got in zip(one, two, three, want):
        p1 = 10 ** (-c * 1000 / lm.STEP)
        p = (pairs[b, c] + lm.BACK2 * p1) / (firsts[b] + lm.BACK2)
        if a:
            p = (triples[a, b, c] + lm.BACK3 * p) / (befores[a, b] + lm.BACK3)
        assert abs(got + math.log10(p) * lm.STEP) < 3


def test_held_out_texts_score_better_than_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", lm.held_out().alias("held_out"))
    r = lm.score(docs).filter("held_out and n_tokens > 20").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > r.b
    assert -r.s / r.n < -r.b / r.n - 0.05
