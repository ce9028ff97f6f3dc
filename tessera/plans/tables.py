"""Roles that the driver's tables play: chunks, framework versions, controls, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import shared_dir, spread
from tessera.operators.lexical_store import LexicalStore

CURRENT = "en"
QUERY = "What control does the thonnt reation and ering address"
VECTOR = 0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work on their texts."""
    return spread(read(spark, sf_dir, "documents"))


def lexical_store(spark: SparkSession, sf_dir: str) -> LexicalStore:
    """Where the stored index of the documents' texts is, or will be, in the shared folder.

    It goes by the table's files, their sizes and times, so that a table that has changed gets another.
    """
    docs = read(spark, sf_dir, "documents")
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    known = docs.select(file.alias("f")).distinct().agg(F.coalesce(F.bit_xor("f"), F.lit(0)).alias("f"), F.count("*").alias("n")).first()
    return LexicalStore(spark, f"{shared_dir(spark)}/lexical-{known.f & (1 << 64) - 1:016x}-{known.n}")


def lexical_index(spark: SparkSession, sf_dir: str) -> LexicalStore:
    """The stored index of the documents' texts; built by the first query that asks for all of it."""
    store = lexical_store(spark, sf_dir)
    if not store.exists():
        try:
            store.build(texts(spark, sf_dir))
        except RuntimeError:
            if not store.exists():  # else another has built it meanwhile
                raise
    return store


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, framework_code, version_label, is_current, status, content."""
    return _chunks(spark, sf_dir, texts(spark, sf_dir))


def _chunks(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    held = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("framework_code"), F.col("lang").alias("version_label"), (F.col("lang") == CURRENT).alias("is_current"), F.col("text").alias("content"))
    return with_status(held, read(spark, sf_dir, "labels"))


def with_status(docs: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.select(F.col("doc_id").alias("chunk_id"), "quality")
    return docs.join(marks, "chunk_id", "left").withColumn("status", F.when(F.col("quality") == 0, "withdrawn").otherwise("active")).drop("quality")


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks() without content: no scan of it reads a text."""
    return _chunks(spark, sf_dir, read(spark, sf_dir, "documents")).drop("content")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = VECTOR) -> list[float]:
    """The embedding of one row, what an embedder would have returned."""
    return list(read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


#: The same roles for DuckDB.
TOKENS = r"""flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{Nd}}.()&-]+'), lambda r: case when (regexp_matches(r, '\p{{L}}') and regexp_matches(r, '[\p{{Nd}}.]')) or (regexp_matches(r, '\p{{Nd}}') and contains(r, '.')) then list_filter([rtrim(r, '.')], lambda x: x <> '') else regexp_extract_all(r, '[\p{{L}}\p{{Nd}}]+') end))"""
TERMS = "'thonnt', 'reation', 'ering'"
WEIGHTS = rf"""tok as (select doc_id, {TOKENS.format('text')} as t from documents),
    sizes as (select doc_id, len(t) as dl, t from tok),
    stats as (select count(*) as n, case when sum(dl) > 0 then sum(dl) / count(*) else 1.0 end as avgdl from sizes),
    tf as materialized (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(t) as term from sizes) group by all),
    df as (select term, count(*) as df from tf group by 1),
    weights as materialized (select doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) as w from tf join df using (term), stats)"""
CHUNKS = "chunks as (select d.doc_id, d.source as framework_code, d.lang as version_label, d.lang = 'en' as is_current, d.text, case when l.quality = 0 then 'withdrawn' else 'active' end as status from documents d left join labels l using (doc_id))"
COSINE = "round(list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6)"
