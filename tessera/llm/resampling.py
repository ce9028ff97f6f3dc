"""Importance resampling towards a target by hashed n-grams, with lines that repeat counted once.

A document's features are its runs of one to three consecutive words, hashed into buckets. A bucket's gain compares how
often the target and all documents hold it; a document's weight is the sum of its features' gains. With Gumbel noise
drawn from the id, the highest scores are a sample without replacement in proportion to the weights' exponentials.

Newlines separate words, so they cut a text into lines, and no feature within a line depends on what stands around it.
Lines repeat, so they are grouped first: each distinct line's features are hashed once, and its counts multiplied by its
occurrences. Features that cross lines are added apart, document by document. The same holds for weights: one for each
distinct line, joined to the documents that have it, plus what crosses lines.

An n-gram's CRC-32 comes from its words': the sum of a concatenation is the first part's, moved on by the second's
length, exclusive-or the second's. Moves are table look-ups, so a feature costs a few array operations and is never
spelt out.

Grouping counts in each task first, so a line that a third of all documents hold is a row a task; the join that follows
meets it once a document, where adaptive execution may split it. What reaches the driver are the buckets' counts, BUCKETS
rows whatever the input, and the sizes of the ranges that the ranks are dealt by.

Defined results: a null or empty text, or one without words, has no features and weight 0. Words are bytes outside
ASCII's punctuation and controls; text that is no valid UTF-8 is made valid first. A null id draws its noise as an empty
one and comes last in ties. Repeated rows stay, each weighed and counted, and ranked next to each other. Very long texts
are read whole. Without documents there are no rows; without a target its counts are zeros. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5

_LETTERS = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(k if k in _LETTERS else k + 32 if 0x41 <= k <= 0x5A else 0x20 for k in range(256))
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]
_NEAR = 64


@lru_cache(maxsize=1)
def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """What moving a CRC-32 on by zero bytes does to each of its bytes: by 0 to 63 of them, and by 64, 128 and so on."""
    polynomial = 0xEDB88320  # fixed value, of CRC-32
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(polynomial), one >> 1)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    near = [now]
    for _ in range(_NEAR):
        now = now >> np.uint32(8) ^ one[now & 255]
        near.append(now)
    far = [near.pop()]
    for _ in range(34):
        far.append(_look_up(far[-1], far[-1]))
    return np.stack(near).reshape(-1), far


def _look_up(moves: np.ndarray, x: np.ndarray) -> np.ndarray:
    return moves[0][x & 255] ^ moves[1][x >> 8 & 255] ^ moves[2][x >> 16 & 255] ^ moves[3][x >> 24]


def moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRC-32s moved on by so many bytes each."""
    near, far = _moves()
    at = (by & (_NEAR - 1)) << 10
    out = near[at + (x & 255)] ^ near[at + 256 + (x >> 8 & 255)] ^ near[at + 512 + (x >> 16 & 255)] ^ near[at + 768 + (x >> 24)]
    rest = by >> 6
    if rest.any():
        for k, moves in enumerate(far):
            own = np.flatnonzero(rest >> k & 1)
            if len(own):
                out[own] = _look_up(moves, out[own])
    return out


def features(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words, a list for each text: the texts' numbers of each word; buckets of the words, of pairs and of triples that end there; and words before each in its text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(sizes.sum())
    flat = [w for words in texts for w in words]
    one = np.fromiter(map(crc32, flat), np.uint32, n)
    long = np.fromiter(map(len, flat), np.int64, n)
    owner = np.repeat(np.arange(len(texts)), sizes)
    before = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    spaced = moved(np.full(n, crc32(b" "), np.uint32), long) ^ one
    two, three = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    two[1:] = moved(one[:-1], long[1:] + 1) ^ spaced[1:]
    three[2:] = moved(two[1:-1], long[2:] + 1) ^ spaced[2:]
    return owner, one % BUCKETS, two % BUCKETS, three % BUCKETS, before


def within(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of all features."""
    owner, one, two, three, before = features(texts)
    pair, triple = before > 0, before > 1
    return np.concatenate([owner, owner[pair], owner[triple]]), np.concatenate([one, two[pair], three[triple]])


def across(texts: list[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and bucket of the features that cross lines; texts: of each its lines' words."""
    owner, _, two, three, before = features([[w for line in lines for w in line] for lines in texts])
    line = np.repeat(np.arange(sum(map(len, texts))), [len(words) for lines in texts for words in lines])
    pair, triple = before > 0, before > 1
    pair[1:] &= line[1:] != line[:-1]
    triple[2:] &= line[2:] != line[:-2]
    return np.concatenate([owner[pair], owner[triple]]), np.concatenate([two[pair], three[triple]])


def _sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of batches with texts of some MB together, a longer one alone."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).to_pylist()]
        start = held = 0
        for k, t in enumerate(texts):
            if held and held + len(t) > most:
                yield batch.slice(start, k - start), texts[start:k]
                start, held = k, 0
            held += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def valid(docs: DataFrame) -> DataFrame:
    """doc_id, text of valid UTF-8, at: a hash of it."""
    return docs.select("doc_id", F.make_valid_utf8("text").alias("text")).withColumn("at", F.xxhash64("text"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x != "")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """line, n: each distinct line and its occurrences, written as a table."""
    return durable(docs.select(F.explode(_lines(F.col("text"))).alias("line")).groupBy("line").agg(F.count("*").alias("n")), "lines")


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("again"), line).alias("b"))


def crossing(docs: DataFrame) -> DataFrame:
    """doc_id, at, n_words, n_features, crossing (buckets as unsigned 16-bit numbers), a row for each document, written as a table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _sliced(batches, "text"):
            lines = [[line.split() for line in t.translate(_FOLD_LINES).split(b"\n")] for t in texts]
            owner, buckets = across(lines)
            order = np.argsort(owner, kind="stable")
            buckets = buckets[order].astype("<u2")
            ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
            words = np.array([sum(map(len, x)) for x in lines], np.int64)
            total = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("at"), pa.array(words), pa.array(total), pa.array([buckets[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())], ["doc_id", "at", "n_words", "n_features", "crossing"])

    found = docs.select("doc_id", "at", F.col("text").cast("binary").alias("text")).mapInArrow(scan, f"doc_id {kind}, at bigint, n_words bigint, n_features bigint, crossing binary")
    return durable(found, "crossing")


def _tallied(rows: DataFrame, tally) -> DataFrame:
    """bucket, n from what tally(batch) adds to the counts of each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            tally(counts, batch)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return rows.mapInArrow(scan, "bucket bigint, n bigint")


def _tally_lines(counts: np.ndarray, batch: pa.RecordBatch) -> None:
    for part, lines in _sliced(iter([batch]), "line"):
        owner, buckets = within([line.translate(_FOLD).split() for line in lines])
        counts += np.bincount(buckets, part.column("n").to_numpy()[owner], BUCKETS).astype(np.int64)


def _tally_crossing(counts: np.ndarray, batch: pa.RecordBatch) -> None:
    counts += np.bincount(np.frombuffer(b"".join(batch.column("crossing").to_pylist()), "<u2"), minlength=BUCKETS)


def bucket_counts(lines: DataFrame, crossed: DataFrame) -> np.ndarray:
    """How many features lie in each bucket."""
    each = _tallied(lines.select(F.col("line").cast("binary").alias("line"), "n"), _tally_lines).unionAll(_tallied(crossed.select("crossing"), _tally_crossing))
    counts = np.zeros(BUCKETS, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The buckets' gains, in thousandths of a natural logarithm, rounded down."""
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + BUCKETS) / ((float(a) + 1) * (t + BUCKETS)))) for a, b in zip(source, target, strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight: a row for each document. target: texts in a column of the given name. Runs the counts when it is called."""
    docs = valid(docs)
    lines, crossed = distinct_lines(docs), crossing(docs)
    aim = valid(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")))
    gain = gains(bucket_counts(lines, crossed), bucket_counts(distinct_lines(aim), crossing(aim)))

    def weigh_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in _sliced(batches, "line"):
            owner, buckets = within([line.translate(_FOLD).split() for line in held])
            weight = np.bincount(owner, gain[buckets], len(held)).astype(np.int64)  # sums in doubles stay whole far beyond any line
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(weight)], ["a", "b", "weight"])

    @F.pandas_udf("bigint")
    def weigh_crossing(x):
        return x.map(lambda buckets: int(gain[np.frombuffer(buckets, "<u2")].sum())).astype("int64")

    by_line = lines.select(_line_key(F.col("line")).alias("k"), F.col("line").cast("binary").alias("line")).select("k.*", "line").mapInArrow(weigh_lines, "a bigint, b bigint, weight bigint").filter("weight <> 0")
    held = docs.select("doc_id", "at", F.explode(F.transform(_lines(F.col("text")), _line_key)).alias("k")).select("doc_id", "at", "k.*")
    summed = held.join(by_line, ["a", "b"]).groupBy(F.col("doc_id").alias("__doc"), F.col("at").alias("__at")).agg(F.sum("weight").alias("lines"))
    # Equal rows share a key, so their sum is so many times a row's weight.
    each = crossed.withColumn("own", weigh_crossing("crossing")).groupBy("doc_id", "at").agg(*[F.first(c).alias(c) for c in ("n_words", "n_features", "own")], F.count("*").alias("copies"))
    found = each.join(summed, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("at") == F.col("__at")), "left")
    weight = F.col("own") + F.expr("coalesce(lines, 0) div copies")
    return found.select("doc_id", "n_words", "n_features", weight.alias("weight"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """scored with rank: 1 to n by score, downwards, ties to the smaller doc_id; null beyond.

    Rows are dealt and sorted by ranges. A row's number within its range, with the sizes of those before, is its rank; the
    driver adds up one size for each range.
    """
    if not n:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    placed = durable(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("__place", 33)
    before, starts = 0, {}
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts[r.part], before = before, before + r["count"]
    if not starts:
        return placed.withColumn("__place", F.lit(None).cast("long")).withColumnRenamed("__place", "rank")
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), part)
    rank = offset + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("rank", F.when(rank <= n, rank.cast("long"))).drop("__place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: of the documents with least_words words, so many in a hundred are drawn and have a rank."""
    scored = durable(weigh(docs, target, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enough = scored.filter(F.col("n_words") >= least_words)
    return ranked(enough, percent * enough.count() // 100).unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"
    # CRC-32, two half bytes at a time, with the table of its polynomial's sixteen remainders
    half = "xor({0} >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108])[({0} & 15) + 1])"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint)), lambda a, b: {half.format(half.format('xor(a, b)'))}), 4294967295) % {BUCKETS}"
    return f"""
with words as materialized (select doc_id, row_number() over () as r, {words} as w from documents), aim_words as materialized (select {words} as w from benchmark),
    found as materialized (select r, f, count(*) as n from (select r, unnest({runs}) as f from words) group by 1, 2),
    aims as materialized (select f, count(*) as n from (select unnest({runs}) as f from aim_words) group by 1),
    known as materialized (select f, {crc} as bucket from (select f from found union select f from aims)),
    s as materialized (select bucket, sum(n) as n from found join known using (f) group by 1), t as materialized (select bucket, sum(n) as n from aims join known using (f) group by 1),
    gain as materialized (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + {BUCKETS})::double / ((s.n + 1)::double * (coalesce((select sum(n) from t), 0) + {BUCKETS})::double)))::bigint as gain from s left join t using (bucket)),
    weights as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from found join known using (f) join gain using (bucket) group by 1),
    scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint as h from words left join weights using (r)),
    scores as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
    ranks as (select *, row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id) as r, (count(*) over (partition by n_words >= {LEAST_WORDS})) * {PERCENT} // 100 as most from scores)
select doc_id, n_features, weight, score, case when n_words >= {LEAST_WORDS} and r <= most then r end as rank from ranks"""


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
ORACLES = {"op11_importance_resampling": _sql()}
