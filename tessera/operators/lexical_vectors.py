"""Hashed vectors of all documents at once, from their texts and without a table of postings.

A task parts its documents in blocks of bounded size and numbers the terms of each block, so that a document is two arrays
of numbers. What is shuffled by term is a row for each distinct term of a block, not one for each of a document; its
frequency and dimension come back to the block as numbers, where weights are taken. Documents go to their block once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions.tokens import DIMENSIONS, dimension, tokens
from tessera.operators import lexical

#: Tokens of a block and of a task that weighs blocks, about, and terms of a block that one row holds.
BLOCK, TASK, ROW = 1_000_000, 4_000_000, 8_192


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (key, tokens) in blocks; a text is not cut."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - before)
            start = stop
            if start < batch.num_rows or size >= BLOCK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _bytes(numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers as 32-bit ones, cut in as many binary values as there are counts."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype(np.int32))])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, a row for each document, its terms' numbers and counts; and rows of its terms in order, from `at` on, with the number of documents that each is in."""
    names = ["block", "key", "dl", "codes", "tfs", "at", "terms", "dfs"]
    for k, block in enumerate(_blocks(batches)):
        number = (TaskContext.get().partitionId() << 32) + k
        keys, lists = (block.column(c).combine_chunks() for c in (0, 1))
        dl = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        n = len(coded.dictionary)
        pairs, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * n + coded.indices.to_numpy(), return_counts=True)
        doc, code = np.divmod(pairs, max(n, 1))
        counts = np.bincount(doc, minlength=len(dl))
        none = [pa.nulls(len(dl), t) for t in (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))]
        yield pa.record_batch([pa.array(np.full(len(dl), number)), keys, pa.array(dl, pa.int32()), _bytes(code, counts), _bytes(tf, counts), *none], names)
        at = np.arange(0, n, ROW, dtype=np.int32)
        cuts = pa.array(np.append(at, n), pa.int32())
        none = [pa.nulls(len(at), t) for t in (keys.type, pa.int32(), pa.binary(), pa.binary())]
        dfs = pa.array(np.bincount(code, minlength=n), pa.int32())
        if n:
            yield pa.record_batch([pa.array(np.full(len(at), number)), *none, pa.array(at), pa.ListArray.from_arrays(cuts, coded.dictionary), pa.ListArray.from_arrays(cuts, dfs)], names)


def document_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, vector: the BM25 weights of every document as (dim, w), in order of the dimensions, terms that collide added up; empty for a text without tokens. Statistics are those of all documents. The numbered documents are written when it is called."""
    kind = docs.schema[key].dataType.simpleString()
    split = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("tokens"))
    held = durable(split.mapInArrow(_numbered, f"block bigint, key {kind}, dl int, codes binary, tfs binary, at int, terms array<string>, dfs array<int>"), "numbered")
    numbered, terms = held.filter("terms is null").select("block", "key", "dl", "codes", "tfs"), held.filter("terms is not null")
    sums = numbered.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    avgdl = sums.total / sums.n if sums.total else 1.0

    each = terms.select("block", "at", F.posexplode(F.arrays_zip("terms", "dfs")).alias("i", "t")).select("block", (F.col("at") + F.col("i")).alias("code"), "t.terms", "t.dfs")
    df = each.groupBy("terms").agg(F.sum("dfs").alias("df"))
    idf = F.log(1 + (F.lit(sums.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = df.select("terms", dimension(F.col("terms")).alias("dim"), idf.alias("idf"))
    # by sorting, as Spark takes a few rows of many terms each for a small table and would broadcast them
    found = each.select("block", "code", "terms").join(known.hint("merge"), "terms").select(F.col("block").alias("of"), "code", "dim", "idf")

    def weigh(part: pa.Table, said: pa.Table) -> pa.Table:
        at = said.column("code").to_numpy()
        dim, idf = np.zeros(len(at), np.int64), np.zeros(len(at))
        dim[at], idf[at] = said.column("dim").to_numpy(), said.column("idf").to_numpy()
        rows = part.column("codes").to_pylist()
        code = np.frombuffer(b"".join(rows), np.int32)
        tf = np.frombuffer(b"".join(part.column("tfs").to_pylist()), np.int32)
        doc = np.repeat(np.arange(len(rows)), [len(r) // 4 for r in rows])
        dl = part.column("dl").to_numpy()
        w = idf[code] * tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * dl[doc] / avgdl))
        places, of = np.unique(doc * (DIMENSIONS + 1) + dim[code], return_inverse=True)
        doc, dim = np.divmod(places, DIMENSIONS + 1)
        entries = pa.StructArray.from_arrays([pa.array(dim, pa.int32()), pa.array(np.bincount(of, w, len(places)), pa.float64())], ["dim", "w"])
        cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(rows)))])
        return pa.table({key: part.column("key"), "vector": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries)})

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sums.total // TASK))
    blocks = numbered.repartition(parts, "block").groupBy("block").cogroup(found.repartition(parts, "of").groupBy("of"))
    return blocks.applyInArrow(weigh, f"`{key}` {kind}, vector array<struct<dim: int, w: double>>")
