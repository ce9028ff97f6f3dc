"""Language-model scores from an Elias-Fano n-gram trie, trained on part of the documents and asked for all.

The model is a trigram model with Dirichlet smoothing: a token's probability after two words is its count there plus
BACK3 times its probability after one, over the context's count plus BACK3; that after one word likewise with BACK2 and
the unigrams, which are counts plus one. All denominators are counts of words and pairs.

1. One scan of the documents writes blocks: a document as the numbers of its words, a block's distinct words as hashes.
2. Distinct words of blocks go to buckets by hash, which add up their counts and number them, frequent ones first; each
   block gets its words' numbers and counts back. A word with a share of over HOT shards' parts of the tokens is hot;
   pairs that end in one are counted the same way.
3. Blocks and counts meet, and every token goes with its two words before to a shard by the word before it. What comes
   after a hot word is dealt by the token too, and what is in a hot pair by all three words; then the counts of their
   contexts go with them, so no shard holds a context that is large against the input.
4. A shard builds its part of the trie from the training tokens and answers all of its tokens; answers are summed to one
   whole number a document and shard, and these by document.

The trie. Below each word stand the tokens that follow it, and the words before it; below these pairs, the tokens that
follow them, each as its rank among those that follow the last word alone. Every level is a monotone sequence in
Elias-Fano form, as are the pointers to the level below; probabilities and back-off weights are kept as 16-bit steps of
1 / STEP in log10. A level is one flat buffer in mapped memory, and is decoded in slices of siblings. A token is looked up
by its rank among the last word's successors, and that rank among the pair's.

Groups are bounded: a block by BLOCK bytes of text, buckets and shards by SHARD, as they are so many as the input needs.
The driver takes totals and, for hot words, 2 / HOT hashes at most, whose bound MOST_SHARDS fixes.

Defined results: a null or empty text is its end alone. A null doc_id is not held out. Repeated rows stay, each counted
and scored. Without training texts every token has the same probability, and the score is 0 for one unknown token. Very
long texts are read whole. Words are told apart by 64-bit hashes; text that is no valid UTF-8 by its bytes. An empty table
gives no rows.
"""

from __future__ import annotations

import mmap
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

FOLDS, HELD = 7, 2
#: Prior counts; on sf0.1, 600 and 40 and 6000 and 15 score held-out texts within a fiftieth of these.
BACK2, BACK3 = 2000.0, 15.0
#: Steps of log10 that a quantised probability counts.
STEP = 4000
BLOCK, SHARD = 8 << 20, 8 << 20
#: Parts of a shard over which a word is hot, and the greatest number of shards in that bound.
HOT, MOST_SHARDS = 0.5, 1 << 15

_FOLD = bytes(k + 32 if 0x41 <= k <= 0x5A else k for k in range(256))
_END = b"\n"  # no word holds it


# Elias-Fano sequences and the trie


class Mapped:
    """Named arrays in one buffer of mapped memory."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        held = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
        self._map = mmap.mmap(-1, max(1, sum(-(-v.nbytes // 8) * 8 for v in held.values())))
        self._at, at = {}, 0
        for k, v in held.items():
            self._map[at : at + v.nbytes] = v.tobytes()
            self._at[k] = at, len(v), v.dtype
            at += -(-v.nbytes // 8) * 8
        self.size = at

    def __getitem__(self, name: str) -> np.ndarray:
        at, n, kind = self._at[name]
        return np.frombuffer(self._map, kind, n, at)


class Monotone:
    """A sequence of whole numbers that never falls, in Elias-Fano form: low bits packed, high bits in unary, and where each EVERY-th number stands in these."""

    EVERY = 512

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, (top // max(1, n)).bit_length() - 1)
        bits = [np.packbits((values[k : k + (1 << 18), None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for k in range(0, n, 1 << 18)] if low else []
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return {"low": np.concatenate(bits) if bits else np.zeros(0, np.uint8), "high": np.packbits(high, bitorder="little"), "samples": ones[:: Monotone.EVERY], "shape": np.array([n, low], np.int64)}

    def __init__(self, at: Callable[[str], np.ndarray]):
        self.low, self.high, self.samples = at("low"), at("high"), at("samples")
        self.n, self.bits = (int(x) for x in at("shape"))

    def slice(self, i: int, j: int) -> np.ndarray:
        """The numbers from place i to before j."""
        if i >= j:
            return np.zeros(0, np.int64)
        first, last = i // self.EVERY, -(-j // self.EVERY)
        begin = int(self.samples[first]) >> 3
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        bits = np.unpackbits(self.high[begin:end], bitorder="little")
        bits[: int(self.samples[first]) - 8 * begin] = 0  # those before the sample
        ones = np.flatnonzero(bits)[i - first * self.EVERY : j - first * self.EVERY] + 8 * begin
        high = (ones - np.arange(i, j)) << self.bits
        if not self.bits:
            return high
        start, stop = i * self.bits, j * self.bits
        low = np.unpackbits(self.low[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + stop - start].reshape(-1, self.bits)
        return high + low @ (1 << np.arange(self.bits, dtype=np.int64))


def _lifted(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sibling groups one after the other as a sequence that never falls: each group is lifted by the last number before it. starts: of each group, and the end."""
    if not len(values):
        return values
    filled = np.flatnonzero(np.diff(starts))
    last = values[starts[filled + 1] - 1]
    lift = np.cumsum(last) - last
    return values + np.repeat(lift, np.diff(starts)[filled])


def _groups(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups starts in sorted group numbers, and the end."""
    return np.searchsorted(keys, np.arange(n + 1))


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-STEP * log10), 0, 65535).astype(np.uint16)


def _real(steps: np.ndarray) -> np.ndarray:
    return 10.0 ** (-steps.astype(float) / STEP)


class Trie:
    """Levels below the words of a shard. Words are numbers over 0."""

    SLICE = 1 << 18

    def __init__(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, steps: np.ndarray, train: np.ndarray, given2: np.ndarray, given12: np.ndarray, given23: np.ndarray):
        """From tokens with the words before them, 0 for none, and steps of their unigram probability. Of the counts given, 0 says none: then those of the training tokens here hold."""
        pair = two << np.int64(32) | three  # numbers within the shard
        before = two << np.int64(32) | one
        b_key, b_at, b_n = np.unique(pair[train], return_index=True, return_counts=True)
        given = np.zeros(len(b_key), np.int64)
        some = np.flatnonzero(given23)
        if len(some):  # pairs that are dealt to several shards
            k, at = np.unique(pair[some], return_index=True)
            place = np.minimum(np.searchsorted(b_key, k), max(0, len(b_key) - 1))
            extra = b_key[place] == k if len(b_key) else np.zeros(len(k), bool)
            given[place[extra]] = given23[some[at[extra]]]
            b_key, order = (x := np.concatenate([b_key, k[~extra]])), np.argsort(x, kind="stable")
            b_key = b_key[order]
            b_n = np.concatenate([np.where(given > 0, given, b_n), given23[some[at[~extra]]]])[order]
            p1 = np.concatenate([steps[train][b_at], steps[some[at[~extra]]]])[order]
        else:
            p1 = steps[train][b_at]
        known2 = train | (given2 > 0)
        words, at2 = np.unique(two[known2], return_index=True)
        own2 = np.bincount(np.searchsorted(words, two[train]), minlength=len(words))
        n2 = np.where(given2[known2][at2] > 0, given2[known2][at2], own2)
        parent = np.searchsorted(words, b_key >> 32)
        q2 = quantised(np.log10((b_n + BACK2 * _real(p1)) / (n2[parent] + BACK2)))
        succ2 = _groups(parent, len(words))

        known3 = (one > 0) & (train | (given12 > 0))
        c_key, at3 = np.unique(before[known3], return_index=True)
        own = train & (one > 0)
        at = np.searchsorted(c_key, before[own])
        n3 = np.where(given12[known3][at3] > 0, given12[known3][at3], np.bincount(at, minlength=len(c_key)))
        c_parent = np.searchsorted(words, c_key >> 32)
        contexts = _groups(c_parent, len(words))
        place = np.searchsorted(b_key, pair[own])
        rank = place - succ2[parent[place]]
        t_key, t_at, t_n = np.unique(at << np.int64(32) | rank, return_index=True, return_counts=True)
        t_parent = t_key >> 32
        q3 = quantised(np.log10((t_n + BACK3 * _real(q2[place[t_at]])) / (n3[t_parent] + BACK3)))
        succ3 = _groups(t_parent, len(c_key))

        low = np.int64((1 << 32) - 1)
        levels = {"words": words, "succ2": succ2, "next2": _lifted(b_key & low, succ2), "contexts": contexts, "before": _lifted(c_key & low, contexts), "succ3": succ3, "next3": _lifted(t_key & low, succ3)}
        held = {f"{name}.{k}": v for name, values in levels.items() for k, v in Monotone.encode(values).items()}
        held |= {"q2": q2, "q3": q3, "back2": quantised(np.log10(BACK2 / (n2 + BACK2))), "back3": quantised(np.log10(BACK3 / (n3 + BACK3)))}
        self.levels = Mapped(held)
        self.seq = {name: Monotone(lambda k, name=name: self.levels[f"{name}.{k}"]) for name in levels}

    def _siblings(self, pointers: str, level: str, i: int, j: int) -> tuple[int, np.ndarray]:
        """Place of the first child of parents i to before j, and their children as parent - i and number in one."""
        ends = self.seq[pointers].slice(i, j + 1)
        first, last = int(ends[0]), int(ends[-1])
        lifted = self.seq[level].slice(max(0, first - 1), last)
        base = 0 if not first else int(lifted[0])
        lifted = lifted if not first else lifted[1:]
        sizes = np.diff(ends)
        if not len(lifted):
            return first, lifted
        before = np.concatenate([[base], lifted])[ends[:-1] - first]  # the last number of the group before
        return first, lifted - np.repeat(before, sizes) + (np.repeat(np.arange(len(sizes)), sizes) << 32)

    @staticmethod
    def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, asked)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == asked[hit]
        return at, hit

    def steps(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """Steps of each token's probability after its words."""
        out = unigram.astype(np.int64)
        words = self.seq["words"].slice(0, self.seq["words"].n)
        at, known = self._find(words, two)
        rows = np.flatnonzero(known)
        rows = rows[np.argsort(at[rows], kind="stable")]
        at = at[rows]
        ends = self.seq["succ2"].slice(0, len(words) + 1) + self.seq["contexts"].slice(0, len(words) + 1)
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + self.SLICE, "right")) - 1)
            own = slice(*np.searchsorted(at, (i, j)))
            if own.start < own.stop:
                self._answer(rows[own], at[own] - i, i, j, one, three, out)
            i = j
        return out

    def _answer(self, rows: np.ndarray, parent: np.ndarray, i: int, j: int, one: np.ndarray, three: np.ndarray, out: np.ndarray) -> None:
        up = parent << np.int64(32)
        first, keys = self._siblings("succ2", "next2", i, j)
        at, hit = self._find(keys, up | three[rows])
        out[rows] = np.where(hit, self.levels["q2"][np.where(hit, first + at, 0)] if len(keys) else 0, out[rows] + self.levels["back2"][i + parent])
        starts = self.seq["succ2"].slice(i, j + 1)
        c_first, c_keys = self._siblings("contexts", "before", i, j)
        c_at, inside = self._find(c_keys, up | one[rows])
        inside &= one[rows] > 0
        if not inside.any():
            return
        rows, hit, rank, context = rows[inside], hit[inside], (first + at - starts[parent])[inside], c_at[inside]
        t_first, t_keys = self._siblings("succ3", "next3", c_first, c_first + len(c_keys))
        t_at, found = self._find(t_keys, context.astype(np.int64) << 32 | np.where(hit, rank, (1 << 32) - 1))
        found &= hit
        out[rows] = np.where(found, self.levels["q3"][np.where(found, t_first + t_at, 0)] if len(t_keys) else 0, out[rows] + self.levels["back3"][c_first + context])


# Blocks, counts, shards


class Numbers(dict):
    """Numbers its keys by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _pack(x: np.ndarray) -> bytes:
    """Bytes of the same place together, as few as the greatest number needs, compressed."""
    x = x.astype(np.uint64)
    width = max(1, -(-int(x.max() if len(x) else 0).bit_length() // 8))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(x: bytes) -> np.ndarray:
    width = x[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.int64).ravel()


def _mix(*parts: np.ndarray) -> np.ndarray:
    """Hashes of whole numbers, taken together."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h = (h ^ p.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def blocks(docs: DataFrame, size: int, hot: float) -> DataFrame:
    """key, ids, held, sizes, codes, hashes, heavy: of each block its documents' ids, marks and tokens as word numbers, its words' hashes, and hashes with counts of those over a share of its tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        known, ids, held, codes, bytes_ = Numbers(), [], [], [], 0
        id_type = pa.null()

        def block() -> pa.RecordBatch:
            flat = np.concatenate(codes)
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known)).view(np.int64)
            n = np.bincount(flat, minlength=len(words))
            heavy = np.flatnonzero(n > hot * len(flat))
            row = [[part << 32 | made], [ids], [np.array(held, bool).tobytes()], [_pack(np.array(list(map(len, codes))))], [_pack(flat)], [words.tobytes()], [[{"hash": int(words[k]), "n": int(n[k])} for k in heavy]], [len(flat)]]
            types = [pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())])), pa.int64()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["key", "ids", "held", "sizes", "codes", "hashes", "heavy", "tokens"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or b""
                if bytes_ and bytes_ + len(text) > size:
                    yield block()
                    made += 1
                    known, ids, held, codes, bytes_ = Numbers(), [], [], [], 0
                words = text.translate(_FOLD).split()
                words.append(_END)
                codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                ids.append(doc)
                held.append(mark)
                bytes_ += len(text) + 1
        if ids:
            yield block()

    found = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"key bigint, ids array<{kind}>, held binary, sizes binary, codes binary, hashes binary, heavy array<struct<hash: bigint, n: bigint>>, tokens bigint")
    return durable(found, "lm-blocks")


def _marks(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, owner, place in its text, and whether it trains, of each token."""
    codes, sizes = _unpack(row["codes"]), _unpack(row["sizes"])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return codes, owner, place, ~np.frombuffer(row["held"], bool)[owner]


def _hot_pairs(codes: np.ndarray, place: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that are hot and not their text's first, and the pair of codes that ends there."""
    at = np.flatnonzero(hot[codes] & (place > 0))
    return at, codes[at - 1] << np.int64(32) | codes[at]


def asked_counts(held: DataFrame, hot: set[int], buckets: int) -> DataFrame:
    """bucket, key, pair, slots, hashes, counts: what each block asks each bucket for, words and pairs that end in a hot word, with its own training counts."""
    hot_hashes = np.array(sorted(hot), np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            codes, _, place, train = _marks(row)
            hashes = np.frombuffer(row["hashes"], np.int64)
            counts = np.bincount(codes[train], minlength=len(hashes))
            at, pairs = _hot_pairs(codes, place, np.isin(hashes, hot_hashes))
            pair, own = np.unique(pairs, return_inverse=True)
            pair_counts = np.bincount(own[train[at]], minlength=len(pair)) if len(pair) else np.zeros(0, np.int64)
            both = _mix(hashes[pair >> 32], hashes[pair & 0xFFFFFFFF]).view(np.int64) if len(pair) else np.zeros(0, np.int64)
            for is_pair, h, n in ((False, hashes, counts), (True, both, pair_counts)):
                by = (_mix(h) % np.uint64(buckets)).astype(np.int64) if len(h) else np.zeros(0, np.int64)
                order = np.argsort(by, kind="stable")
                ends = np.searchsorted(by[order], np.arange(buckets + 1))
                out = [(b + is_pair * buckets, row["key"], is_pair, _pack(np.diff(s := order[i:j], prepend=0)), h[s].tobytes(), _pack(n[s])) for b, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
                for k in range(0, len(out), 64):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out[k : k + 64]), (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "key", "pair", "slots", "hashes", "counts"])

    return held.select("key", "held", "sizes", "codes", "hashes").mapInArrow(ask, "bucket bigint, key bigint, pair boolean, slots binary, hashes binary, counts binary")


def answered_counts(asked: DataFrame, hot: set[int], buckets: int) -> DataFrame:
    """key, pair, slots, numbers, counts, hot: to each block the numbers and training counts of what it asked a bucket for; and for each bucket a row of no key with its sums."""
    hot_hashes = np.array(sorted(hot), np.int64)

    def answer(rows: pa.Table) -> pa.Table:
        bucket, pair = rows.column("bucket")[0].as_py(), rows.column("pair")[0].as_py()
        hashes = [np.frombuffer(x.as_py(), np.int64) for x in rows.column("hashes")]
        known, own = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(own, np.concatenate([_unpack(x.as_py()) for x in rows.column("counts")]), len(known)).astype(np.int64)
        numbers = np.empty(len(known), np.int64)
        numbers[np.argsort(-counts, kind="stable")] = np.arange(len(known)) * buckets + bucket % buckets + 1
        parts = np.split(own, np.cumsum(list(map(len, hashes)))[:-1])
        cells = [(_pack(np.zeros(0)) if pair else _pack(numbers[p]), _pack(counts[p]), np.isin(known[p], hot_hashes).tobytes() if not pair else b"") for p in parts]
        total = (None, pair, None, None, None, None, 0 if pair else int(counts.sum()), 0 if pair else int((counts > 0).sum()))
        out = [(k, pair, s, *c, None, None) for k, s, c in zip(rows.column("key").to_pylist(), rows.column("slots").to_pylist(), cells, strict=True)] + [total]
        types = (pa.int64(), pa.bool_(), *[pa.binary()] * 4, pa.int64(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], ["key", "pair", "slots", "numbers", "counts", "hot", "tokens", "words"])

    found = asked.groupBy("bucket").applyInArrow(answer, "key bigint, pair boolean, slots binary, numbers binary, counts binary, hot binary, tokens bigint, words bigint")
    return durable(found, "lm-counts")


def sent_tokens(held: DataFrame, answers: DataFrame, shards: int, tokens: int, words: int, hot: float) -> DataFrame:
    """shard, key, part, rest: a block's tokens for each shard, packed; and for one shard its documents' totals, as rest."""
    kind = held.schema["ids"].dataType.simpleString()
    rest_type = f"struct<ids: {kind}, held: binary, sizes: binary, known: binary, base: array<double>, first: binary>"
    mass = tokens + words + 1

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        id_type = left.schema.field("ids").type
        rests = pa.struct([("ids", id_type), ("held", pa.binary()), ("sizes", pa.binary()), ("known", pa.binary()), ("base", pa.list_(pa.float64())), ("first", pa.binary())])
        row = {c: left.column(c)[0].as_py() for c in ("key", "held", "sizes", "codes", "n_words")}
        codes, owner, place, train = _marks(row)
        number, count, hot_word = np.zeros(row["n_words"], np.int64), np.zeros(row["n_words"], np.int64), np.zeros(row["n_words"], bool)
        pair_answers = []
        for r in right.to_pylist():
            slots = np.cumsum(_unpack(r["slots"]))
            if r["pair"]:
                pair_answers.append((slots, _unpack(r["counts"])))
            else:
                number[slots], count[slots], hot_word[slots] = _unpack(r["numbers"]), _unpack(r["counts"]), np.frombuffer(r["hot"], bool)
        at, pairs = _hot_pairs(codes, place, hot_word)
        pair, own = np.unique(pairs, return_inverse=True)
        pair_count = np.zeros(len(pair), np.int64)
        for slots, n in pair_answers:
            pair_count[slots] = n
        ending = np.zeros(len(codes), np.int64)  # of pairs that end in a hot word
        ending[at] = pair_count[own] if len(pair) else 0
        docs = len(left.column("ids")[0])
        p1 = np.log10((count + 1.0) / mass)
        q1 = quantised(p1)
        base = np.bincount(owner, p1[codes], docs)
        known = np.bincount(owner, count[codes] > 0, docs).astype(np.int64)
        first = q1[codes[place == 0]].astype(np.int64)

        t = np.flatnonzero(place > 0)
        three, two = number[codes[t]], number[codes[t - 1]]
        one = np.where(place[t] > 1, number[codes[np.maximum(t - 2, 0)]], 0)
        hot2 = hot_word[codes[t - 1]]
        hot23 = hot2 & hot_word[codes[t]] & (ending[t] > 2 * hot * tokens)
        given2 = np.where(hot2, count[codes[t - 1]], 0)
        given12 = np.where(hot2 & (one > 0), ending[t - 1], 0)
        given23 = np.where(hot23, ending[t], 0)
        shard = (_mix(two, np.where(hot2, three, 0), np.where(hot23, one, 0)) % np.uint64(shards)).astype(np.int64) if len(t) else np.zeros(0, np.int64)
        order = np.lexsort((two, three, shard)) if len(t) < 1 << 16 else np.argsort(shard << np.int64(44) | three, kind="stable")
        at = t[order]
        doc, steps = owner[at] << 1 | train[at], q1[codes[at]]
        del ending, owner, place, train, codes, t, at, hot2, hot23
        shard, three, two, one, given2, given12, given23 = (x[order] for x in (shard, three, two, one, given2, given12, given23))
        ends = np.searchsorted(shard, np.arange(shards + 1))
        out = []
        for s, (i, j) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            if i < j:
                cells = (np.diff(three[i:j], prepend=0), two[i:j], one[i:j], doc[i:j], steps[i:j], given2[i:j], given12[i:j], given23[i:j])
                out.append((s, row["key"], [_pack(c) for c in cells], None))
        held_rest = {"ids": left.column("ids")[0].as_py(), "held": row["held"], "sizes": row["sizes"], "known": _pack(known), "base": base, "first": _pack(first)}
        out.append((row["key"] % shards, row["key"], None, held_rest))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.binary()), rests), strict=True)], ["shard", "key", "part", "rest"])

    own = held.select("key", "ids", "held", "sizes", "codes", (F.octet_length("hashes") / 8).cast("long").alias("n_words"))
    replies = answers.filter("key is not null").select("key", "pair", "slots", "numbers", "counts", "hot")
    return own.groupBy("key").cogroup(replies.groupBy("key")).applyInArrow(send, f"shard bigint, key bigint, part array<binary>, rest {rest_type}")


def answered_tokens(sent: DataFrame) -> DataFrame:
    """key, docs, steps, rest: of each block the steps that a shard adds to its documents; rest goes through."""
    rest_type = dict(sent.dtypes)["rest"]

    def answer(rows: pa.Table) -> pa.Table:
        rows_of = rows.filter(rows.column("part").is_valid())
        parts = [(k, [_unpack(c) for c in p]) for k, p in zip(rows_of.column("key").to_pylist(), rows_of.column("part").to_pylist(), strict=True)]
        docs, steps = [], []
        if parts:
            sizes = [len(p[0]) for _, p in parts]
            three = np.concatenate([np.cumsum(p[0]) for _, p in parts])
            two, one, doc, unigram, given2, given12, given23 = (np.concatenate([p[c] for _, p in parts]) for c in range(1, 8))
            owners = [k for k, _ in parts]
            del parts, rows_of
            words = np.unique(np.concatenate([np.unique(one), np.unique(two), np.unique(three), [0]]))  # 0, none, stays 0
            one, two, three = (np.searchsorted(words, x) for x in (one, two, three))
            found = Trie(one, two, three, unigram, (doc & 1).astype(bool), given2, given12, given23).steps(one, two, three, unigram)
            at = 0
            for n in sizes:
                sums = np.bincount(doc[at : at + n] >> 1, found[at : at + n]).astype(np.int64)
                some = np.flatnonzero(sums)
                docs.append(_pack(np.diff(some, prepend=0)))
                steps.append(_pack(sums[some]))
                at += n
        else:
            owners = []
        rest = rows.filter(rows.column("rest").is_valid())
        none = [None] * rest.num_rows
        kinds = rows.schema.field("rest").type
        return pa.table([pa.array(owners + rest.column("key").to_pylist(), pa.int64()), pa.array(docs + none, pa.binary()), pa.array(steps + none, pa.binary()), pa.concat_arrays([pa.nulls(len(owners), kinds), *rest.column("rest").chunks])], ["key", "docs", "steps", "rest"])

    return sent.groupBy("shard").applyInArrow(answer, f"key bigint, docs binary, steps binary, rest {rest_type}")


def summed(answers: DataFrame, tokens: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = answers.schema["rest"].dataType["ids"].dataType.elementType.simpleString()

    def add(rows: pa.Table) -> pa.Table:
        rest = next(r for r in rows.column("rest") if r.is_valid)
        ids, row = pa.concat_arrays([rest["ids"].values]), {k: rest[k].as_py() for k in ("held", "sizes", "known", "base", "first")}
        steps = _unpack(row["first"]).copy()
        for docs, own in zip(rows.column("docs").to_pylist(), rows.column("steps").to_pylist(), strict=True):
            if docs is not None:
                steps[np.cumsum(_unpack(docs))] += _unpack(own)
        cells = [np.frombuffer(row["held"], bool), _unpack(row["sizes"]), _unpack(row["known"]), np.full(len(ids), tokens), np.array(row["base"]), -steps / STEP]
        return pa.table([ids, *map(pa.array, cells)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return answers.groupBy("key").applyInArrow(add, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, hot: float = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document. docs: doc_id, text, held_out. Writes blocks and counts when it is called."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard))
    share = hot / min(shards, MOST_SHARDS)
    held = blocks(docs, block, share)
    total = held.agg(F.sum("tokens")).first()[0] or 0
    heavy = held.select(F.explode("heavy").alias("h")).groupBy("h.hash").agg(F.sum("h.n").alias("n")).filter(F.col("n") > share / 2 * total)
    hot_words = {r.hash for r in heavy.select("hash").collect()}  # 2 / share at most
    answers = answered_counts(asked_counts(held, hot_words, shards), hot_words, shards)
    sums = answers.filter("key is null").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, words = sums.tokens or 0, sums.words or 0
    return summed(answered_tokens(sent_tokens(held, answers, shards, tokens, words, share)), tokens)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD, F.lit(False))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out")))


QUERIES = {"op12_lm_scoring": op12_lm_scoring}
ORACLES: dict[str, str] = {}
