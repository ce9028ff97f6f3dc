import hashlib
import struct

from pyspark.sql import functions as F

from tessera.llm import bpe


def want(text):
    t = bpe.tokenizer(bpe.VOCABULARY)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op7_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids, text = want(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows_in_small_blocks(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "Hello's  wörld x y<|endoftext|> 12"), (4, "Hello's  wörld x y<|endoftext|> 12"), (None, "é ́ ß İ ſ"), (7, "x" * 20000), (8, "a b " * 3000), (9, "\x1c\x85 ok")]
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))), bytes(r.decoded).decode()) for r in bpe.encode_decode(df, block=64, buckets=3).collect()), key=repr)
    assert got == sorted(((d, *want(t)) for d, t in docs), key=repr)
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_slices_and_invalid_utf8(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 64)  # many slices: a word is encoded in each
    docs = [(k, f"shared words and own{k} " * 3) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))) for r in bpe.encode_decode(df, block=128, buckets=2).collect()}
    assert got == {d: want(t)[0] for d, t in docs}
    bad = spark.sql("select 1L as doc_id, cast(X'61ff62' as string) as text")
    assert [bytes(r.decoded).decode() for r in bpe.encode_decode(bad).collect()] == [want("a�b")[1]]


def test_rows_in_another_order_at_each_scan(spark):
    docs = [(k, f"shared words and own{k} " * 3) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).orderBy(F.rand()).repartition(3)
    got = {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))) for r in bpe.encode_decode(df, block=128, buckets=2).collect()}
    assert got == {d: want(t)[0] for d, t in docs}
    once = bpe.steady(df)
    assert [r.doc_id for r in once.collect()] == [r.doc_id for r in once.collect()]
