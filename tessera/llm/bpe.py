"""BPE encoding and decoding over a distinct-word table.

White space never enters a token of the vocabulary, so a text's ids are its words' ids in order. Words repeat, so each
distinct one is encoded once:

1. Each task splits its documents into blocks of bounded size, numbers a block's distinct words by first appearance,
   and keeps a document as the numbers of its words.
2. Blocks belong to slices of about `SLICE` bytes of text. A block's distinct words go to its slice's buckets by hash; a
   bucket holds the same words of all blocks of a slice, encodes each distinct word once, and answers with the ids in
   each block's order.
3. Numbers and ids meet again by block: ids are joined back by position, pieces by id.

Step 1 scans the documents twice, once for words and once for numbers, and a block is known by its rows, so both scans
have to find them in the same order. Files have one, and are scanned as they are; what is no plain scan of files is
written first, as is a table of so few files that it has to be dealt out.

Only distinct words of blocks, their ids and word numbers are shuffled, all packed; texts never are. A block is bounded
by its bytes of text, and a bucket by those of a slice, of which it holds one part in `BUCKETS`; slices are as many as
the input needs, so a group does not grow with it. A frequent word counts once a block, and nothing is cached or
collected.

Defined results: a null or empty text has no ids and decodes to an empty text. Repeated rows stay, each encoded. A
null doc_id is a value as any other. An empty table gives no rows. Very long words are encoded whole. In text that is no
valid UTF-8, what cannot be read is taken as U+FFFD.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of text in a block, unless one document alone is longer.
BLOCK = 32 << 20
#: Bytes of text in a slice, about, within which each distinct word is encoded once, and parts of its words.
SLICE, BUCKETS = 4 << 30, 64


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> list[bytes]:
    """The piece of each id."""
    t = tokenizer(vocabulary)
    return [(t.id_to_token(i) or "").encode() for i in range(max(t.get_vocab().values()) + 1)]


def encode_words(words: list[bytes], vocabulary: str, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids, one after the other, and how many each word has."""
    t, ids, lens = tokenizer(vocabulary), [np.empty(0, np.uint32)], []
    for k in range(0, len(words), step):
        out = [e.ids for e in t.encode_batch_fast([w.decode(errors="replace") for w in words[k : k + step]], add_special_tokens=False)]
        lens += map(len, out)
        ids.append(np.fromiter((i for x in out for i in x), np.uint32))
    return np.concatenate(ids), np.array(lens, np.uint32)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + lens[k]] for each k, one after the other."""
    ends = np.cumsum(lens)
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


class Numbers(dict):
    """Numbers its keys by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pack(x: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())


def _unpack(x: bytes, kind: type | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list, list[np.ndarray], Numbers]]:
    """Key, doc_ids, numbers of each document's words, and words. The key stands for the block's rows, so a second scan finds the same one."""
    ids, codes, known, key, held = [], [], Numbers(), xxhash.xxh3_128(), 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or b""
            if held and held + len(text) > size:
                yield key.hexdigest(), ids, codes, known
                ids, codes, known, key, held = [], [], Numbers(), xxhash.xxh3_128(), 0
            words = text.split()
            ids.append(doc)
            codes.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
            key.update(f"{doc}:{len(text)}:".encode())
            key.update(text)
            held += len(text) + 1
    if ids:
        yield key.hexdigest(), ids, codes, known


def block_words(docs: DataFrame, buckets: int, size: int, slices: int = 1) -> DataFrame:
    """bucket, key, words, codes: a block's distinct words in its slice's buckets by hash, with their numbers."""

    def scan(batches):
        for key, _, _, known in _blocks(batches, size):
            first = int(key[:15], 16) % slices * buckets
            words = list(known)
            by = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int32, len(words))
            order = np.argsort(by, kind="stable")
            ends = np.searchsorted(by[order], np.arange(buckets + 1))
            own = [(first + b, order[i:j]) for b, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
            rows = [(b, key, _pack(b" ".join(words[c] for c in codes)), _pack(np.diff(codes, prepend=0).astype(np.uint32))) for b, codes in own]
            for k in range(0, len(rows), 64):
                yield pa.record_batch([pa.array(x) for x in zip(*rows[k : k + 64], strict=True)], schema=pa.schema([("bucket", pa.int32()), ("key", pa.string()), ("words", pa.binary()), ("codes", pa.binary())]))

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(scan, "bucket int, key string, words binary, codes binary")


def encode_buckets(words: DataFrame, vocabulary: str) -> DataFrame:
    """key, codes, lens, ids: each distinct word of a bucket is encoded once, for all blocks."""

    def encode(rows: pa.Table) -> pa.Table:
        known, held = Numbers(), []
        for row in rows.column("words"):
            own = _unpack(row.as_py()).split(b" ")
            held.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        flat, lens = encode_words(list(known), vocabulary)
        starts = np.cumsum(lens, dtype=np.int64) - lens
        out = [(_pack(lens[own]), _pack(gather(flat, starts[own], lens[own].astype(np.int64)))) for own in held]
        return pa.table([rows.column("key"), rows.column("codes"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["key", "codes", "lens", "ids"])

    return words.groupBy("bucket").applyInArrow(encode, "key string, codes binary, lens binary, ids binary")


def block_documents(docs: DataFrame, size: int) -> DataFrame:
    """key, docs, counts, codes: a block's documents as the numbers of their words; byte planes apart, which packs well."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type
        again = (b for part in ([first], batches) for b in part)
        for key, ids, codes, known in _blocks(again, size):
            flat = np.concatenate(codes)
            planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T)
            yield pa.record_batch([pa.array([key]), pa.array([ids], pa.list_(kind)), pa.array([_pack(np.array([len(c) for c in codes], np.int64))]), pa.array([len(known)], pa.int64()), pa.array([_pack(planes)], pa.binary())], ["key", "docs", "counts", "n_words", "codes"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(scan, f"key string, docs array<{doc_type}>, counts binary, n_words bigint, codes binary")


def steady(docs: DataFrame) -> DataFrame:
    """doc_id and text, written, so that every scan and every retried task finds the same rows in the same order."""
    return durable(docs.select("doc_id", "text"), "texts")


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the decoded text, both binary, of every document."""
    return _joined(steady(docs), vocabulary, block, buckets, False)


def _joined(docs: DataFrame, vocabulary: str, block: int, buckets: int | None, digest: bool) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    encoded = encode_buckets(block_words(docs, buckets or BUCKETS, block, max(1, -(-size // SLICE))), vocabulary)
    numbered = block_documents(docs, block)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("n_tokens", pa.int64())] + ([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.binary()), ("decoded", pa.binary())]))

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError(f"block {key} has words and no documents: its two scans differ")
        size = left.column("n_words")[0].as_py()
        starts, lens, flat, at = np.zeros(size, np.int64), np.full(size, -1, np.int64), [np.empty(0, np.uint32)], 0
        for codes, n, ids in zip(*(right.column(c).to_pylist() for c in ("codes", "lens", "ids")), strict=True):
            codes, n, ids = np.cumsum(_unpack(codes, np.uint32), dtype=np.int64), _unpack(n, np.uint32).astype(np.int64), _unpack(ids, np.uint32)
            starts[codes], lens[codes] = at + np.cumsum(n) - n, n
            flat.append(ids)
            at += len(ids)
        if size and lens.min() < 0:
            raise ValueError(f"block {key} lacks words: its two scans differ")
        flat, table_of = np.concatenate(flat), pieces(vocabulary)
        spelt, all_ids = [], flat.tolist()
        for s, n in zip(starts.tolist(), lens.tolist(), strict=True):
            spelt.append(b" ".join([table_of[i] for i in all_ids[s : s + n]]))
        del all_ids
        some = lens > 0  # a word of what the vocabulary drops has no ids, and no place in the decoded text
        out = []
        for row in range(left.num_rows):
            planes = _unpack(left.column("codes")[row].as_py(), np.uint8)
            codes = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1)
            ends = np.cumsum(_unpack(left.column("counts")[row].as_py(), np.int64))
            for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own = codes[i:j]
                ids = gather(flat, starts[own], lens[own]).astype("<u4").tobytes()
                text = b" ".join([spelt[c] for c in own[some[own]].tolist()])
                out.append((len(ids) // 4, *((hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) if digest else (ids, text))))
        values = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)]
        docs_of = pa.concat_arrays([x.flatten() for x in left.column("docs").chunks])
        return pa.table([docs_of, *values], ["doc_id", *schema.names])

    columns = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    return numbered.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(join, f"doc_id {doc_type}, n_tokens bigint, {columns}")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    files = spark.read.parquet(path)
    few = len(files.inputFiles()) < spark.sparkContext.defaultParallelism
    return _joined(steady(table(spark, sf_dir, "documents")) if few else files, VOCABULARY, BLOCK, None, True)


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
