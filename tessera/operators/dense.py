"""Dense retrieval: exact cosine top-k over an array column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 50
DECIMALS = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v as a unit vector; a zero vector stays."""
    scaled = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm(v)), scaled), F.lit(0))  # the norm is taken once, not at each element


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors, rounded; null if one is zero or their lengths differ. Norms that are known already are not taken again for each pair."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.round(dot(a, b) / size, DECIMALS))


def top_k(vectors: DataFrame, query: Sequence[float], k: int = TOP_K, within: DataFrame | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, similarity of the k nearest, ties to the smaller key. The query is a literal, so a task keeps its own k best."""
    if within is not None:
        vectors = vectors.join(within.select(key).distinct(), key, "left_semi")
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, cosine(F.col(column), asked).alias("similarity")).filter("similarity is not null")
    return scored.orderBy(F.desc("similarity"), key).limit(k)


Allowed = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def _packed(rows: DataFrame, key: str, column: str, fields: Sequence[str], block: int) -> DataFrame:
    """dims, at, ids, matrix, fields: rows in blocks of vectors of one length. Vectors that are null, of length or norm 0, or with null or non-finite components are in none."""
    kind = dict(rows.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, vectors, marks = zip(*held.pop(dims))
            cells = [pa.array([dims], pa.int32()), pa.array([part << 32 | made]), pa.array([list(ids)], pa.list_(id_type)), pa.array([np.array(vectors, np.float32).tobytes()], pa.binary()), pa.array([[list(m) for m in zip(*marks)] if fields else []], pa.list_(pa.list_(pa.int64())))]
            return pa.record_batch(cells, ["dims", "at", "ids", "matrix", "fields"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            marks = list(zip(*(batch.column(2 + k).to_pylist() for k in range(len(fields))))) if fields else [()] * batch.num_rows
            for one, vector, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), marks, strict=True):
                own = held.setdefault(len(vector), [])
                own.append((one, vector, mark))
                if len(own) == block:
                    yield flush(len(vector))
        for dims in list(held):
            yield flush(dims)

    sound = rows.filter(F.coalesce((F.size(column) > 0) & ~F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(column, lambda v: v != 0), F.lit(False)))
    return sound.select(key, F.col(column).cast("array<float>").alias(column), *[F.col(f).cast("long") for f in fields]).mapInArrow(pack, f"dims int, at bigint, ids array<{kind[key]}>, matrix binary, fields array<array<bigint>>")


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "vec_id", query: str = "query_id", column: str = "embedding", apart: bool = False, fields: Sequence[str] = (), query_fields: Sequence[str] = (), allowed: Allowed | None = None, block: int = 1024) -> DataFrame:
    """query, key, similarity, rank: exact cosine top-k of many queries, ties to the smaller key.

    Vectors and queries are packed in blocks. Every block of queries is sent to each of some slots, every block of vectors
    to one, and an equal slot joins the two, so each pair of blocks meets once; a pair is one matrix product in a task, of
    which it keeps each query's best. These are ranked by a window whose limit stands before the shuffle. Cosines of
    double precision are rounded before they are ranked, so a block keeps all that may round to its k-th.

    apart: a vector is no hit of the query of its own key. allowed: from whole-number fields of queries and of vectors, by
    name, which may be a query's hits, as a matrix of queries by vectors.
    """
    spark = vectors.sparkSession
    slots = max(1, spark.sparkContext.defaultParallelism)
    v = _packed(vectors, key, column, fields, block).withColumn("slot", F.pmod(F.xxhash64("at"), F.lit(slots)).cast("int"))
    q = _packed(queries, query, column, query_fields, block).select("dims", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("fields").alias("q_fields"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    near = 0.6 * 10**-DECIMALS

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = lambda raw, dims: (m := np.frombuffer(raw, np.float32).reshape(-1, dims).astype(float)) / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        for batch in batches:
            for n in range(batch.num_rows):
                own, asked = batch.column("ids")[n].values, batch.column("q_ids")[n].values
                dims = batch.column("dims")[n].as_py()
                found = unit(batch.column("q_matrix")[n].as_py(), dims) @ unit(batch.column("matrix")[n].as_py(), dims).T
                if apart:
                    found[np.array(asked.to_pylist(), object)[:, None] == np.array(own.to_pylist(), object)[None]] = -np.inf
                if allowed is not None:
                    named = lambda names, column: dict(zip(names, map(np.array, batch.column(column)[n].as_py()), strict=True))  # noqa: E731, B023
                    found[~allowed(named(query_fields, "q_fields"), named(fields, "fields"))] = -np.inf
                least = np.partition(found, -k, 1)[:, -k] if found.shape[1] > k else np.full(len(found), -2.0)
                row, place = np.nonzero((found >= least[:, None] - near) & (found > -2))
                yield pa.record_batch([asked.take(pa.array(row)), own.take(pa.array(place)), pa.array(found[row, place])], [query, key, "similarity"])

    kinds = {query: dict(queries.dtypes)[query], key: dict(vectors.dtypes)[key]}
    pairs = v.join(q, ["slot", "dims"]).select("dims", "ids", "matrix", "fields", "q_ids", "q_matrix", "q_fields")
    best = pairs.mapInArrow(multiply, f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, similarity double").withColumn("similarity", F.round("similarity", DECIMALS))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("similarity"), key))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)
