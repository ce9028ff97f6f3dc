"""Embedding chunks with an injected embedder, and the chunk table itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions.text import chunk_content, context_prefix, embedding_text
from tessera.operators import mapping, state, tree
from tessera.published import Published

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hash_embedder(texts: Sequence[str], dims: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words, always the same for a text: for tests and for wiring."""
    import zlib

    out = np.zeros((len(texts), dims))
    for k, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[k, h % dims] += 1 if h >> 16 & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def embed(texts: DataFrame, load: Callable[[], Embedder], batch: int = 32, key: str = "id", column: str = "text") -> DataFrame:
    """key and embedding. load() runs once in each task, so a model is loaded once; texts go to it in batches, long ones together."""
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = load()
        for part in parts:
            order = np.argsort([len(t or "") for t in part], kind="stable")
            out: list = [None] * len(part)
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                vectors = embedder([part.iloc[i] or "" for i in own])
                if len(vectors) != len(own):
                    raise ValueError(f"{len(own)} texts gave {len(vectors)} vectors")
                for i, v in zip(own, vectors, strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return texts.select(key, run(F.col(column)).alias("embedding"))


def embed_missing(chunks: DataFrame, embeddings: DataFrame, model: str, load: Callable[[], Embedder]) -> DataFrame:
    """chunk_id, model, dims, embedding of the chunks that have none by this model: rows to append."""
    due = state.missing_embeddings(chunks, embeddings, model).select("id", embedding_text(F.col("context_prefix"), F.col("content")).alias("text"))
    found = embed(due, load)
    return found.select(F.col("id").alias("chunk_id"), F.lit(model).alias("model"), F.size("embedding").alias("dims"), "embedding")


def embed_in_rounds(store: Published, chunks: DataFrame, model: str, load: Callable[[], Embedder], part_rows: int = 100_000, parts_a_round: int = 32, most_rounds: int | None = None) -> int:
    """Embeds what the store's table `vectors` lacks of the chunks, by this model and with this text, and returns the number of rounds that it took.

    Chunks fall into parts by a hash of their id, and each round embeds some parts and publishes their rows as one more
    version, so an interrupted run loses its last round at most. What is due is found anew by each call, from what is
    published: calling again resumes, calling once more does nothing, and a chunk whose text has changed is due again.
    chunks: id, context_prefix, content. vectors: chunk_id, model, text_md5, dims, embedding.
    """
    text = embedding_text(F.col("context_prefix"), F.col("content"))
    wanted = chunks.select("id", text.alias("text")).withColumn("text_md5", F.md5(F.col("text").cast("binary")))
    due = wanted
    if "vectors" in store.listed():
        have = store.read("vectors").filter(F.col("model") == model).select(F.col("chunk_id").alias("id"), "text_md5")
        due = wanted.join(have, ["id", "text_md5"], "left_anti")
    ledger = durable(due.select("id"), "due")  # ids only: texts are read again with each round's parts
    n = -(-ledger.count() // part_rows)
    rounds = -(-n // parts_a_round)
    done = min(rounds, most_rounds) if most_rounds is not None else rounds
    part = F.pmod(F.xxhash64("id"), F.lit(max(n, 1)))
    for k in range(done):
        mine = part.between(k * parts_a_round, (k + 1) * parts_a_round - 1)
        rows = wanted.filter(mine).join(ledger.filter(mine), "id", "left_semi")
        found = embed(rows.withColumn("key", F.struct("id", "text_md5")), load, key="key")
        store.append({"vectors": found.select(F.col("key.id").alias("chunk_id"), F.lit(model).alias("model"), "key.text_md5", F.size("embedding").alias("dims"), "embedding")})
    return done


def latest_vectors(store: Published, model: str, chunks: DataFrame) -> DataFrame:
    """chunk_id, model, dims, embedding of the chunks' present texts."""
    now = chunks.select(F.col("id").alias("chunk_id"), F.md5(embedding_text(F.col("context_prefix"), F.col("content")).cast("binary")).alias("text_md5"))
    return store.read("vectors").filter(F.col("model") == model).join(now, ["chunk_id", "text_md5"], "left_semi").select("chunk_id", "model", "dims", "embedding")


def build_chunks(controls: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """control_id, citation, context_prefix, content, ordinal of every control: one chunk each, by a stable id.

    controls: id, document_id, parent_id, citation, title, body. edges: from_id, to_id of equivalents.
    """
    docs = documents.select(F.col("id").alias("document_id"), "framework_code", "version_label")
    paths = tree.ancestors(controls)
    best = mapping.longest_equivalent(edges, controls.select("id", "body"))
    other = controls.join(docs, "document_id").select(F.col("id").alias("to_id"), F.col("framework_code").alias("ef"), F.col("citation").alias("ec"))
    best = best.join(other, "to_id").select(F.col("from_id").alias("id"), "ef", "ec", F.col("body").alias("eb"))
    held = controls.join(docs, "document_id").join(paths, "id").join(best, "id", "left")
    prefix = context_prefix(F.col("framework_code"), F.col("version_label"), F.col("path"), F.col("title"))
    content = chunk_content(F.col("citation"), F.col("title"), F.col("body"), F.col("ef"), F.col("ec"), F.col("eb"))
    return held.select(F.xxhash64("id", F.lit(0)).alias("id"), F.col("id").alias("control_id"), "citation", prefix.alias("context_prefix"), content.alias("content"), F.lit(0).alias("ordinal"))


def model_rows(embeddings: DataFrame, model: str) -> DataFrame:
    """How many rows an embedder's model has, and under which names else: 0 means that a search would find nothing."""
    from tessera.functions.text import same_model

    return embeddings.agg(F.count_if(F.col("model") == model).alias("rows"), F.count_if((F.col("model") != model) & same_model(F.col("model"), F.lit(model))).alias("under_other_names"))
