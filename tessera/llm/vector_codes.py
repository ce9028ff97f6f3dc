"""Vector codes: product quantisation whose nearest entries are found by equal-average search.

A vector is cut into equal parts, and each part position has a codebook. Rounds of assigning and averaging refine the
codebooks; then every part is coded by its nearest entry. Entries are sorted by their component sum. For a part, the
search begins at the entries whose sums are nearest to the part's own and goes outward both ways; by Cauchy's inequality
the squared gap of the sums over the dimension bounds the squared distance from below, so a way ends where that bound
strictly exceeds the best distance. Equal bounds are still looked at, since ties go to the lower index.

Each round is one pass over the vectors in Arrow batches. A task sends a sum and a count for each entry, and what
reaches the driver is the codebooks: parts times entries rows at most, whatever the input.

All arithmetic is in integers. Defined results: rows whose vector is null, or holds null or non-finite components, are
dropped, and so are rows whose length is not that of the smallest vec_id kept, and all rows if that length is zero or no
multiple of the parts. A component beyond +-2^26 after scaling counts as that bound, so that sums fit a long. Null ids
come after all others where the first codebook is taken; equal ids go by their vectors. Repeated rows stay, each coded
and each counted. With fewer rows than entries, codebooks have as many entries as rows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Greatest size of a scaled component.
MOST = 1 << 26


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest row of book to each row of x, ties to the lower index, by equal-average search."""
    n, dim, size = len(x), x.shape[1], len(book)
    order = np.argsort(book.sum(1), kind="stable")
    entries = book[order]
    sums, own = entries.sum(1), x.sum(1)
    at = np.searchsorted(sums, own)
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    ways = [(np.arange(n), at.copy(), 1), (np.arange(n), at - 1, -1)]
    while any(len(rows) for rows, _, _ in ways):
        for k, (rows, place, step) in enumerate(ways):
            if not len(rows):
                continue
            inside = (place >= 0) & (place < size)
            rows, place = rows[inside], place[inside]
            gap = own[rows] - sums[place]
            open_ = -(-gap * gap // dim) <= best[rows]  # the bound is no more than the best: gap^2 / dim <= best
            rows, place = rows[open_], place[open_]
            far = x[rows] - entries[place]
            distance, found = np.einsum("ij,ij->i", far, far), order[place]
            better = (distance < best[rows]) | ((distance == best[rows]) & (found < index[rows]))
            best[rows[better]], index[rows[better]] = distance[better], found[better]
            ways[k] = rows, place + step, step
    return index, best


def kept_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows that are kept, with vector, whole numbers in place of column; and its length. The one action is for the first row's length."""
    finite = F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long")
    sound = vectors.filter(F.coalesce(finite, F.lit(False)))
    first = sound.select(key, F.size(column).alias("n"), F.xxhash64(column).alias("h")).orderBy(F.col(key).asc_nulls_last(), "h").select("n").first()
    size = first.n if first and first.n and first.n % parts == 0 else 0
    return sound.filter((F.size(column) == size) & F.lit(size > 0)).withColumn("vector", F.transform(column, scaled)), size


def _matrix(batch: pa.RecordBatch, size: int, name: str = "vector") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def first_books(vectors: DataFrame, key: str, size: int, parts: int, entries: int) -> list[np.ndarray]:
    held = vectors.select(key, "vector").orderBy(F.col(key).asc_nulls_last(), F.xxhash64("vector")).limit(entries).collect()
    held = np.array([r.vector for r in held], np.int64).reshape(len(held), size)
    return list(held.reshape(len(held), parts, size // parts).transpose(1, 0, 2))


def averaged(vectors: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks after a round: each entry is the floor of the mean of its parts; an entry without parts stays."""
    wide = size // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), wide + 1), np.int64) for b in books]
        for batch in batches:
            x = _matrix(batch, size).reshape(-1, len(books), wide)
            for p, book in enumerate(books):
                found, _ = nearest(x[:, p], book)
                for d in range(wide):
                    np.add.at(total[p][:, d], found, x[:, p, d])
                total[p][:, wide] += np.bincount(found, minlength=len(book))
        for p, own in enumerate(total):
            used = np.flatnonzero(own[:, wide])
            slots = np.repeat(used, wide + 1), np.tile(np.arange(wide + 1), len(used))
            yield pa.record_batch([pa.array(np.full(len(slots[0]), p)), pa.array(slots[0]), pa.array(slots[1]), pa.array(own[slots])], ["part", "entry", "slot", "value"])

    rows = vectors.select("vector").mapInArrow(sums, "part long, entry long, slot long, value long").groupBy("part", "entry", "slot").agg(F.sum("value").alias("value")).collect()
    total = [np.zeros((len(b), wide + 1), np.int64) for b in books]
    for r in rows:
        total[r.part][r.entry, r.slot] = r.value
    return [np.where(t[:, wide:] > 0, np.floor_divide(t[:, :wide], np.maximum(t[:, wide:], 1)), b) for t, b in zip(total, books, strict=True)]


def train(vectors: DataFrame, key: str, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part position."""
    books = first_books(vectors, key, size, parts, entries)
    for _ in range(rounds):
        books = averaged(vectors, books, size)
    return books


def coded(vectors: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """vectors with codes, an index for each part, and error, the squared distances summed over the parts, in place of vector."""
    wide = size // len(books)
    rest = [c for c in vectors.columns if c != "vector"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, size).reshape(-1, len(books), wide)
            found = [nearest(x[:, p], book) for p, book in enumerate(books)]
            codes = np.stack([i for i, _ in found], 1).astype(np.int32)
            ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(books))
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array(sum(d for _, d in found))], [*rest, "codes", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select(*rest, "vector").mapInArrow(assign, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", codes array<int>, error bigint")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, extra: tuple[str, ...] = ()) -> tuple[DataFrame, list[np.ndarray]]:
    """key, extra columns, codes and error of every vector kept; and the codebooks. Runs the rounds when it is called."""
    kept, size = kept_vectors(vectors.select(key, column, *extra), key, column, parts)
    kept = kept.select(key, *extra, "vector")
    if not size:
        return kept.select(key, *extra, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), []
    books = train(kept, key, size, parts, entries, rounds)
    return coded(kept, books, size), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = encode(table(spark, sf_dir, "embeddings"), extra=("label",))
    found = durable(found, "vector-codes")
    by_label = found.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0")), "")
    held = found.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return held.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    assigned = "{name} as materialized (select id, part, x, e as entry, d from (select v.id, v.part, v.x, b.entry as e, list_sum(list_transform(list_zip(v.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts v join {book} b using (part)) qualify row_number() over (partition by id, part order by d, e) = 1)"
    means = "{name} as materialized (select b.part, b.entry, case when m.y is null then b.y else m.y end as y from {book} b left join (select part, entry, list(v order by place) as y from (select part, entry, place, floor(sum(v)::hugeint / count(*))::bigint as v from (select part, entry, unnest(x) as v, generate_subscripts(x, 1) as place from {own}) group by 1, 2, 3) group by 1, 2) m using (part, entry))"
    steps, book = [], "b0"
    for k in range(ROUNDS + 1):
        steps.append(assigned.format(name=f"a{k}", book=book))
        if k < ROUNDS:
            steps.append(means.format(name=f"b{k + 1}", book=book, own=f"a{k}"))
            book = f"b{k + 1}"
    return f"""
with sound as (select *, row_number() over (order by vec_id) - 1 as id from embeddings where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: coalesce(not isfinite(x), true)))),
    whole as materialized (select id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from sound),
    parts as materialized (select id, p as part, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as x from whole, range({PARTS}) r(p)),
    b0 as materialized (select part, id as entry, x as y from parts where id < {ENTRIES}), {", ".join(steps)},
    sums as (select id, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by 1),
    book as (select sha256(string_agg(array_to_string(y, ','), ',' order by part, entry)) as digest from {book})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from sums join sound using (id), book"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _sql()}
