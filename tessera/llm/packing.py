"""Packing: documents in order, cut into windows where padding and broken documents cost least.

Documents are dealt by ranges to partitions, in order of doc_id, then of a hash of the text, then of where the row
stands, so that even equal rows are spread. A partition is read as a stream, and cut into shards of bounded documents
and bytes; a shard is one stream of ids. Windows of at most `length` ids may end at a document's end for nothing, at a
sentence's end for a small penalty, and, where neither is near, after any 64th id for a larger one. The cheapest cuts
are found by dynamic programming over these places; since padding is linear in a window's start, the best start is the
least of a sliding window, kept in a monotone queue, and each place is pushed and popped once. A shard's last window is
split into sequences whose lengths are powers of two, which need no padding.

sequence_id is the number of the partition, then a counter within it. A task that runs again gives the same pieces, as
long as docs can be read again in the same order, as a table can.

Defined results: a null or empty text is its end id alone. Equal rows are packed each for itself, next to each other.
Rows without a doc_id come first. Ids may be any longs, near or far from each other. Very long texts run over as many
windows as they need. An empty table gives no rows. Text that is no valid UTF-8 is read with U+FFFD for what cannot be
read. Columns other than doc_id and text are passed by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import VOCABULARY, encode_words, gather
from tessera.llm.common import table

LENGTH = 4096
END_ID = 2
#: Documents and bytes of text in a shard at most, unless one document alone is longer.
SHARD, SHARD_BYTES = 8192, 16 << 20
#: Bytes of text in a partition: as many as the session's shuffle has, of at least the first size, and no larger than about the second.
PARTITION_BYTES = 2 << 20, 128 << 20
#: Words that a Python worker keeps the ids of.
KEPT_WORDS = 600_000
#: Penalties in ids of padding: a cut at a sentence's end, and one elsewhere.
SENTENCE, ELSEWHERE = 4, 32
#: Where two places are further apart than GAP, every STEP ids between them is one more.
GAP, STEP = 128, 64
_CLOSERS = b"\"')]}"


def places(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream may be cut, ascending, and what that costs. ends: of documents; sentences: of sentences."""
    kind = np.zeros(ends[-1] + 1, np.uint8)
    kind[sentences] = 2
    kind[ends] = 1
    at = np.nonzero(kind)[0]
    gaps = np.diff(at, prepend=0)
    for k in np.nonzero(gaps > GAP)[0]:
        kind[at[k] - gaps[k] + STEP : at[k] : STEP] = 3
    every = np.nonzero(kind)[0]
    return every, np.array([0, 0, SENTENCE, ELSEWHERE])[kind[every]]


def best_cuts(at: list[int], cost: list[int], length: int) -> list[int]:
    """Ends of the windows, the last one's at[-1], that minimise padding plus penalties; the last window needs no padding.

    best(i) = cost(i) + length - at(i) + min over j with at(i) - at(j) <= length of best(j) + at(j). Neighbours in `at`
    are at most `length` apart.
    """
    at, cost = [0, *at], [0, *cost]
    best, start, key, queue, head = [0], [0], [0], [0], 0
    for i in range(1, len(at)):
        here = at[i]
        while here - at[queue[head]] > length:
            head += 1
        j = queue[head]
        value = cost[i] + length - here + key[j]
        best.append(value)
        start.append(j)
        k = value + here
        key.append(k)
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    i = len(at) - 1
    j = min((j for j in range(np.searchsorted(at, at[i] - length), i)), key=lambda j: (best[j], j))
    cuts = [at[i]]
    while j:
        cuts.append(at[j])
        j = start[j]
    return cuts[::-1]


def powers(n: int) -> list[int]:
    """n as a sum of distinct powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_shard(ids: np.ndarray, ends: np.ndarray, sentences: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(number of the document, start, length, crc32, document's ids, sequence's number, offset) of each piece of a stream of ids. ends: of its documents."""
    every, cost = places(ends, sentences)
    cuts = best_cuts(every.tolist(), cost.tolist(), length)
    last = cuts[-2] if len(cuts) > 1 else 0
    bounds = cuts[:-1] + (last + np.cumsum(powers(cuts[-1] - last))).tolist()
    raw, seq, opened, at = memoryview(ids.astype("<u4").tobytes()), 0, 0, 0
    for doc, end in enumerate(ends.tolist()):
        begin = at
        while at < end:
            stop = min(end, bounds[seq])
            yield doc, at - begin, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), end - begin, seq, at - opened
            at = stop
            if stop == bounds[seq]:
                seq, opened = seq + 1, stop


class Encoder(dict):
    """Numbers words, and has the ids of each number: those of new words once they are wanted. Number 0 stands for the end id."""

    def __init__(self, vocabulary: str, end_id: int):
        super().__init__()
        self.vocabulary, self.words = vocabulary, []
        self.flat, self.lens, self.closes = np.array([end_id], np.uint32), np.ones(1, np.int64), np.zeros(1, bool)

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = n = len(self.words)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.split()
        found = np.zeros(len(words) + 1, np.uint32)
        found[:-1] = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers' ids, one after the other, where each ends, and whether it closes a sentence."""
        if fresh := self.words[len(self.lens) - 1 :]:
            flat, lens = encode_words(fresh, self.vocabulary)
            closes = np.fromiter((w.rstrip(_CLOSERS)[-1:] in (b".", b"!", b"?") for w in fresh), bool, len(fresh))
            self.flat, self.lens, self.closes = np.append(self.flat, flat), np.append(self.lens, lens), np.append(self.closes, closes)
        starts, lens = np.cumsum(self.lens) - self.lens, self.lens[numbers]
        return gather(self.flat, starts[numbers], lens), np.cumsum(lens), self.closes[numbers]

    def forget(self, keep: int) -> None:
        """Forgets all words but the first ones, which are the frequent ones."""
        for word in self.words[keep:]:
            del self[word]
        self.flat = self.flat[: self.lens[: keep + 1].sum()]
        self.words, self.lens, self.closes = self.words[:keep], self.lens[: keep + 1], self.closes[: keep + 1]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, end_id: int) -> Encoder:
    """This worker's encoder, with KEPT_WORDS words at most."""
    if (found := _encoders.get((vocabulary, end_id))) is None:
        found = _encoders[vocabulary, end_id] = Encoder(vocabulary, end_id)
    found.forget(KEPT_WORDS)
    return found


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece. One shuffle puts the documents in order."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    some = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(1, min(some, size // PARTITION_BYTES[0]), -(-size // PARTITION_BYTES[1]))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("place"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    dealt = keyed.repartitionByRange(partitions, "doc_id", "place", "row").sortWithinPartitions("doc_id", "place", "row")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], Encoder]]:
        docs, numbers, held, own = [], [], 0, encoder(vocabulary, end_id)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if docs and (len(docs) >= shard or held + len(text) > SHARD_BYTES):
                    yield docs, numbers, own
                    docs, numbers, held, own = [], [], 0, encoder(vocabulary, end_id)
                docs.append(doc)
                numbers.append(own.numbers(text))
                held += len(text)
        if docs:
            yield docs, numbers, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for docs, numbers, own in shards(batches):
            ids, after, closes = own.ids(np.concatenate(numbers))
            ends = after[np.cumsum([len(n) for n in numbers]) - 1]
            sentences = after[closes]
            pieces = list(pack_shard(ids, ends, sentences[sentences > 0], length))
            cols = [np.array(x, np.int64) for x in zip(*pieces, strict=True)]
            yield pa.record_batch([pa.array(docs, pa.int64()).take(pa.array(cols[0])), *map(pa.array, cols[1:5]), pa.array(cols[5] + first), pa.array(cols[6])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            first += pieces[-1][5] + 1

    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
