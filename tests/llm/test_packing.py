import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest

from tessera.llm import packing
from tessera.llm.bpe import VOCABULARY, tokenizer


def ids_of(text):
    return [*tokenizer(VOCABULARY).encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, docs, length=packing.LENGTH):
    """rows: of pack(); docs: list of (doc_id, text). Returns ids of padding."""
    own = defaultdict(list)
    for doc, text in docs:
        own[doc].append(ids_of(text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(own)
    for doc, found in pieces.items():
        if len(own[doc]) == 1:
            (ids,) = own[doc]
            at = 0
            for r in sorted(found, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        assert sum(r.length for r in found) == sum(map(len, own[doc]))
    pad = 0
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert found[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in pairwise(found))
        n = found[-1].offset + found[-1].length
        assert n <= length
        pad += 0 if n & (n - 1) == 0 else length - n
    return pad


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = packing.op8_packing(spark, sf_dir).collect()
    assert check(rows, docs) < 0.01 * sum(r.length for r in rows)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "one. two. three."), (3, "one. two. three."), (None, "no id"), (None, None), (9, "word " * 9000), (10, "x" * 30000), (-5, "below\n\n zero <|endoftext|> é")]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, shard int")
    check(packing.pack(df).collect(), docs)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    at = np.unique(np.append(rng.integers(1, 60, 14), 60))
    at = np.union1d(at, np.arange(8, 60, 8)).tolist()
    cost = [0 if i == len(at) - 1 else int(c) for i, c in enumerate(rng.integers(0, 6, len(at)))]

    def price(cuts):
        return sum(cost[at.index(c)] for c in cuts[:-1]) + sum(16 - (b - a) for a, b in pairwise([0, *cuts[:-1]]))

    def all_cuts(start):
        if at[-1] - start <= 16:
            yield [at[-1]]
        for c in at[:-1]:
            if start < c <= start + 16:
                for rest in all_cuts(c):
                    yield [c, *rest]

    found = packing.best_cuts(at, cost, 16)
    assert all(0 < b - a <= 16 for a, b in pairwise([0, *found]))
    assert price(found) == min(map(price, all_cuts(0)))


def test_powers():
    assert packing.powers(13) == [8, 4, 1] and packing.powers(4096) == [4096]


def padding(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack(df, **how).collect()
    return rows, check(rows, docs)


@pytest.mark.parametrize("step", [1, 100_000, 1 << 50])
def test_ids_near_and_far(spark, step):
    docs = [(k * step - (1 << 59), "some words of a text. " * (20 + k % 7)) for k in range(400)]
    rows, pad = padding(spark, docs)
    total = sum(r.length for r in rows)
    assert pad < 0.01 * total and len({r.sequence_id for r in rows}) < 4 * (total / packing.LENGTH + 12)
    assert {r.doc_id for r in rows} == {d for d, _ in docs}


def test_rows_that_share_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_BYTES", (1 << 12, 1 << 20))
    docs = [((1 << 63) - 1, f"text {k % 50} and more.") for k in range(4000)] + [(None, "equal text.")] * 4000 + [(-(1 << 63), "least")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = packing.pack(df, shard=512).collect()
    assert check(rows, docs) == 0 or check(rows, docs) < 0.02 * sum(r.length for r in rows)
    by_doc = defaultdict(set)
    for r in rows:
        by_doc[r.doc_id].add(r.sequence_id >> 40)
    assert all(len(by_doc[d]) > 1 for d in (None, (1 << 63) - 1))  # more than one partition


def test_invalid_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(X'61ff62' as string) as text union all select 2L, 'fine'")
    rows = packing.pack(df).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {1: len(ids_of("a�b")), 2: len(ids_of("fine"))}
