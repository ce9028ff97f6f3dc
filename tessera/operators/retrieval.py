"""Hybrid search: citation pins, a dense and a lexical arm, fusion, and what surrounds them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions.citations import cite_string, match_citations, version_status
from tessera.operators import dense, fusion, lexical
from tessera.operators.lexical_many import Arm
from tessera.operators.lexical_store import LexicalStore

MODES = ("hybrid", "vector", "bm25")
PINS, LINEAGE = 16, 3


@dataclass(frozen=True)
class Options:
    """What a search is asked for. version pins a version in place of the current one; a number that is not over 0 stands for the default."""

    top_k: int = 8
    vector_k: int = 50
    bm25_k: int = 50
    rrf_k: int = 20
    doc_cap: int = 0
    lexical_weight: float = 0.5
    mode: str = "hybrid"
    framework: str = ""
    version: str = ""
    current_only: bool | None = None
    include_withdrawn: bool = False
    scheme: str | None = None
    abstain_floor: float = 0.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {MODES}")
        for name in ("top_k", "vector_k", "bm25_k", "rrf_k", "doc_cap", "lexical_weight"):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, type(self).__dataclass_fields__[name].default)

    @property
    def shows_older(self) -> bool:
        """Whether hits of older versions are appended: only where neither currency, a framework nor a version is asked for."""
        return self.current_only is None and not self.framework and not self.version

    def without_vector(self) -> Options:
        """What is left of a search that has no query vector."""
        if self.mode == "vector":
            raise ValueError("a vector search needs a query vector")
        return replace(self, mode="bm25")


def eligible(keys: DataFrame, o: Options, non_current: bool = False) -> DataFrame:
    """Chunks that may be found: by framework, by pinned version or else the current one, and by status. Deprecated ones never are."""
    held = keys.filter(F.col("status").isin(*(["active", "withdrawn"] if o.include_withdrawn else ["active"])))
    if o.framework:
        held = held.filter(F.col("framework_code") == o.framework)
    if non_current:
        return held.filter(~F.col("is_current"))
    if o.version:
        return held.filter(F.col("version_label") == o.version)
    return held if o.current_only is False else held.filter("is_current")


def pinned(keys: DataFrame, query: str, o: Options) -> DataFrame:
    """Chunks whose citation the query names: at most PINS, current versions first. keys: with citation_norm and ordinal."""
    spark = keys.sparkSession
    asked = spark.range(1).select(F.explode(match_citations(F.lit(query), o.scheme)).alias("m")).select(F.col("m.citation").alias("citation_norm")).distinct()
    held = eligible(keys, o).join(F.broadcast(asked), "citation_norm")  # the citations of one query
    held = held.orderBy(F.desc("is_current"), "framework_code", "version_label", "citation_norm", "ordinal", "chunk_id").limit(PINS)
    order = [F.desc("is_current"), "framework_code", "version_label", "citation_norm", "ordinal", "chunk_id"]
    return held.select("chunk_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def search(chunks: DataFrame, vectors: DataFrame | None, query: str, vector: Sequence[float] | None = None, o: Options = Options(), index: LexicalStore | None = None) -> DataFrame:
    """rank, chunk_id, score, vector_rank, bm25_rank, similarity, bm25_score and the chunk's fields, in order.

    chunks: chunk_id, framework_code, version_label, is_current, status, content; with citation_norm and ordinal if
    citations are to be pinned. vectors: chunk_id, embedding. Filters stand before scoring; an arm hands on ids and
    scores only, and what is returned is looked up at the end. index: the stored lexical index of all chunks, by chunk_id;
    without one the query's terms are looked for in their texts.
    """
    if not query:
        return chunks.limit(0).select(F.lit(0).alias("rank"), "chunk_id")
    if vector is None or vectors is None:
        o = o.without_vector()
    keys = chunks.drop("content")
    pins = pinned(keys, query, o) if "citation_norm" in chunks.columns else None
    n_pins = pins.count() if pins is not None else 0
    allowed = eligible(keys, o).select("chunk_id")
    spark = chunks.sparkSession
    none = lambda s: spark.createDataFrame([], f"chunk_id long, {s} double, rank int")
    near = none("similarity")
    if o.mode != "bm25":
        near = fusion.with_rank(dense.top_k(vectors, vector, o.vector_k, allowed, "chunk_id"), "similarity", "chunk_id")
    words, asked = none("bm25_score"), None
    if o.mode != "vector":
        terms = lexical.terms_of(spark, query)
        asked = index.asked(terms, "chunk_id") if index else lexical.asked_weights(lexical.asked_index(chunks, terms, "chunk_id", "content"), "chunk_id")
        words = fusion.with_rank(lexical.best(asked, o.bm25_k, allowed, "chunk_id"), "score", "chunk_id").withColumnRenamed("score", "bm25_score")
    weight = max(o.lexical_weight, fusion.PINNED_WEIGHT) if n_pins else o.lexical_weight
    left = max(o.top_k - n_pins, 1)
    fused = fusion.fuse(near, words, "chunk_id", o.rrf_k, weight).limit(left)
    fused = fused.join(near.select("chunk_id", "similarity"), "chunk_id", "left").join(words.select("chunk_id", "bm25_score"), "chunk_id", "left")
    hits = fusion.with_rank(fused, "score", "chunk_id")
    if o.doc_cap:
        group = keys.select("chunk_id", "framework_code")
        hits = fusion.cap_per_group(hits.join(group, "chunk_id"), "framework_code", o.doc_cap, left).drop("framework_code")
    if n_pins:
        lead = pins.select("chunk_id", F.lit(1.0).alias("score"), F.lit(0).alias("vector_rank"), F.lit(0).alias("bm25_rank"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("bm25_score"), "rank")
        hits = fusion.merge_pinned(lead, hits, "chunk_id", o.top_k)
    if o.shows_older:
        hits = fusion.append_new(hits, lineage_hits(keys, vectors, vector, o, asked), "chunk_id")
    return hits.join(keys, "chunk_id").orderBy("rank")


def lineage_hits(keys: DataFrame, vectors: DataFrame | None, vector: Sequence[float] | None, o: Options, asked: DataFrame | None = None) -> DataFrame:
    """A few hits of versions that are not current, the best of each framework and version. keys: chunks without content; asked: weights of the query's terms."""
    allowed = eligible(keys, o, non_current=True).select("chunk_id")
    k = min(LINEAGE, o.top_k)
    null = F.lit(None).cast("double")
    if o.mode != "bm25":
        found = fusion.with_rank(dense.top_k(vectors, vector, k, allowed, "chunk_id"), "similarity", "chunk_id").withColumns({"bm25_score": null, "vector_rank": F.col("rank"), "bm25_rank": F.lit(0), "score": F.col("similarity") * 0})
    else:
        found = fusion.with_rank(lexical.best(asked, k, allowed, "chunk_id"), "score", "chunk_id").withColumnRenamed("score", "bm25_score").withColumns({"similarity": null, "vector_rank": F.lit(0), "bm25_rank": F.col("rank"), "score": F.lit(0.0)})
    own = fusion.best_per_group(found.join(keys.select("chunk_id", "framework_code", "version_label"), "chunk_id"), ["framework_code", "version_label"])
    return own.select("chunk_id", "score", "vector_rank", "bm25_rank", "similarity", "bm25_score", "rank")


def _may(o: Options, non_current: bool = False) -> Column:
    """eligible() as a condition on a query's fields and a chunk's, side by side."""
    status = (F.col("status") == "active") | (F.col("withdrawn") & (F.col("status") == "withdrawn"))
    held = status & ((F.col("framework") == "") | (F.col("framework_code") == F.col("framework")))
    if non_current:
        return held & ~F.col("is_current")
    current = F.lit(True) if o.current_only is False else F.col("is_current")
    return held & F.when(F.col("version") != "", F.col("version_label") == F.col("version")).otherwise(current)


_CHUNK_FIELDS = ("framework_of", "version_of", "current_of", "status_of")
_QUERY_FIELDS = ("framework_asked", "any_framework", "version_asked", "any_version", "withdrawn_too")


def _base(q: dict[str, np.ndarray], v: dict[str, np.ndarray]) -> np.ndarray:
    up = lambda x: x[:, None]
    status = (v["status_of"] == 0) | (up(q["withdrawn_too"]) > 0) & (v["status_of"] == 1)
    return status & ((up(q["any_framework"]) > 0) | (up(q["framework_asked"]) == v["framework_of"]))


def _may_current(q: dict[str, np.ndarray], v: dict[str, np.ndarray]) -> np.ndarray:
    return _base(q, v) & np.where(q["any_version"][:, None] > 0, v["current_of"][None] > 0, q["version_asked"][:, None] == v["version_of"][None])


def _may_any(q: dict[str, np.ndarray], v: dict[str, np.ndarray]) -> np.ndarray:
    return _base(q, v) & ((q["any_version"][:, None] > 0) | (q["version_asked"][:, None] == v["version_of"][None]))


def _may_old(q: dict[str, np.ndarray], v: dict[str, np.ndarray]) -> np.ndarray:
    return _base(q, v) & (v["current_of"][None] == 0)


def _ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def search_many(keys: DataFrame, vectors: DataFrame, queries: DataFrame, index: LexicalStore, o: Options = Options()) -> DataFrame:
    """query_id, rank, chunk_id, score, vector_rank, bm25_rank, similarity, bm25_score: search() for every query at once.

    queries: query_id, query, and as they like embedding, framework, version and include_withdrawn, in place of what the
    options say; a query without an embedding has its lexical arm only, one without text no hits. keys: chunks without
    content. Arms, fusion, caps, pins and lineage are joins and windows by query, and their limits stand before the
    shuffles. Filters stand before ranks: within the dense arm's products, and on each batch that the lexical arm has scored.
    """
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in queries.columns else F.lit(other)
    vector = F.col("embedding") if "embedding" in queries.columns else F.lit(None).cast("array<float>")
    q = queries.filter("query <> ''").select("query_id", "query", vector.alias("embedding"), has("framework", o.framework).alias("framework"), has("version", o.version).alias("version"), has("include_withdrawn", o.include_withdrawn).alias("withdrawn"))
    q = durable(q.withColumn("dense", F.col("embedding").isNotNull() & F.lit(o.mode != "bm25")), "queries")
    asks = q.select("query_id", "framework", "version", "withdrawn", "dense")
    lineage = o.current_only is None

    chunk = {"framework_of": F.xxhash64("framework_code"), "version_of": F.xxhash64("version_label"), "current_of": F.col("is_current").cast("long"), "status_of": F.when(F.col("status") == "active", 0).when(F.col("status") == "withdrawn", 1).otherwise(2)}
    asked = {"framework_asked": F.xxhash64("framework"), "any_framework": (F.col("framework") == "").cast("long"), "version_asked": F.xxhash64("version"), "any_version": (F.col("version") == "").cast("long"), "withdrawn_too": F.col("withdrawn").cast("long")}
    held = vectors.select("chunk_id", "embedding").join(keys.select("chunk_id", *[c.alias(n) for n, c in chunk.items()]), "chunk_id")
    near_of = lambda rows, k, may: dense.top_k_many(held, rows.filter("dense").select("query_id", "embedding", *[c.alias(n) for n, c in asked.items()]), k, "chunk_id", fields=_CHUNK_FIELDS, query_fields=_QUERY_FIELDS, allowed=may)
    near = near_of(q, o.vector_k, _may_any if o.current_only is False else _may_current).withColumnRenamed("rank", "v")

    terms = lexical.query_terms(q)
    # A row may be a hit of the query's own arm or, where it has no vector, one of its older ones; only the best of either are kept.
    may_old = lambda q, v: _may_old(q, v) & (q["older_too"] > 0)[:, None]
    arms = {1: Arm(o.bm25_k, _may_any if o.current_only is False else _may_current)} | ({2: Arm(LINEAGE, may_old)} if lineage else {})
    older = F.lit(lineage) & (F.col("framework") == "") & (F.col("version") == "") & ~F.col("dense")
    if o.mode == "vector":
        terms = terms.limit(0)
    fields = q.select("query_id", *[c.alias(n) for n, c in asked.items()], older.cast("long").alias("older_too"))
    words = index.best_many(terms, arms, fields, keys.select(F.col("chunk_id").cast("long").alias("key"), *[c.cast("long").alias(n) for n, c in chunk.items()]))
    words = durable(words.select("query_id", F.col("key").alias("chunk_id"), F.col("score").alias("bm25_score"), F.col("rank").alias("b"), "arm"), "scored")
    word = words.filter((F.col("arm") == 1) & (F.col("b") <= o.bm25_k)).drop("arm")

    fused = near.join(word, ["query_id", "chunk_id"], "full")
    pins = None
    weight, left = F.lit(float(o.lexical_weight)), F.lit(o.top_k)
    if "citation_norm" in keys.columns:
        named = q.select("query_id", F.explode(match_citations(F.col("query"), o.scheme)).alias("m")).select("query_id", F.col("m.citation").alias("citation_norm")).distinct()
        pins = named.join(keys, "citation_norm").join(asks, "query_id").filter(_may(o))
        pins = durable(_ranked(pins, F.desc("is_current"), "framework_code", "version_label", "citation_norm", "ordinal", "chunk_id").filter(F.col("rank") <= PINS).select("query_id", "chunk_id", "rank"), "pins")
        fused = fused.join(pins.groupBy("query_id").agg(F.count("*").cast("int").alias("pins")), "query_id", "left")
        weight = F.when(F.col("pins") > 0, float(max(o.lexical_weight, fusion.PINNED_WEIGHT))).otherwise(weight)
        left = F.greatest(o.top_k - F.coalesce("pins", F.lit(0)), F.lit(1))
    part = lambda rank, w: F.coalesce(w / (F.col(rank) + o.rrf_k), F.lit(0.0))
    fused = fused.withColumn("score", F.round(part("v", F.lit(1.0)) + part("b", weight), fusion.DECIMALS)).withColumn("left", left)
    hits = _ranked(fused, F.desc("score"), "chunk_id").filter(F.col("rank") <= F.col("left"))
    if o.doc_cap:
        own = F.row_number().over(Window.partitionBy("query_id", "framework_code").orderBy("rank")) > o.doc_cap
        hits = _ranked(hits.join(keys.select("chunk_id", "framework_code"), "chunk_id").withColumn("over", own), "over", F.col("rank"), name="place").withColumn("rank", F.col("place"))
    none = F.lit(None).cast("double")
    zero = F.lit(0)
    shape = lambda rows, arm: rows.select("query_id", "chunk_id", "score", F.coalesce("v", zero).alias("vector_rank"), F.coalesce("b", zero).alias("bm25_rank"), "similarity", "bm25_score", F.lit(arm).alias("arm"), "rank")
    out = shape(hits, 1)
    if pins is not None:
        lead = shape(pins.withColumns({"score": F.lit(1.0), "v": zero, "b": zero, "similarity": none, "bm25_score": none}), 0)
        both = lead.unionByName(out.join(pins.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
        out = _ranked(both, "arm", "rank", "chunk_id", name="place").filter((F.col("arm") == 0) | (F.col("place") <= o.top_k)).withColumn("rank", F.col("place")).drop("place")
    if lineage:
        k = min(LINEAGE, o.top_k)
        free = q.filter("framework = '' and version = ''")
        by_vector = near_of(free, k, _may_old).withColumns({"score": F.lit(0.0), "v": F.col("rank"), "b": zero, "bm25_score": none})
        by_words = words.filter((F.col("arm") == 2) & (F.col("b") <= k)).withColumns({"score": F.lit(0.0), "v": zero, "rank": F.col("b"), "similarity": none})
        older = shape(by_vector, 2).unionByName(shape(by_words, 2)).join(keys.select("chunk_id", "framework_code", "version_label"), "chunk_id")
        own = F.row_number().over(Window.partitionBy("query_id", "framework_code", "version_label").orderBy("rank"))
        older = older.withColumn("own", own).filter("own = 1").select(out.columns)
        out = durable(out, "hits")
        out = out.unionByName(older.join(out.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
    return _ranked(out, "arm", F.col("rank"), "chunk_id", name="place").select("query_id", F.col("place").alias("rank"), "chunk_id", "score", "vector_rank", "bm25_rank", "similarity", "bm25_score")


def evidence(hits: DataFrame, floor: float = 0.0) -> DataFrame:
    """One row: hits, top_score (of scores below 1), top_cosine, abstained: nothing found, or, where an arm was dense, no cosine at the floor."""
    held = hits.agg(F.count("*").alias("hits"), F.max(F.when(F.col("score") < 1.0, F.col("score"))).alias("top_score"), F.max("similarity").alias("top_cosine"), F.coalesce(F.max(F.col("vector_rank") > 0), F.lit(False)).alias("dense"))
    low = F.col("dense") & (F.lit(floor) > 0) & (F.coalesce("top_cosine", F.lit(0.0)) < floor)
    return held.select("hits", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("top_cosine", F.lit(0.0)).alias("top_cosine"), ((F.col("hits") == 0) | low).alias("abstained"))


def shaped(hits: DataFrame) -> DataFrame:
    """What a caller sees: the cite string and the version's status in place of ids and ranks of arms."""
    return hits.select("rank", cite_string(F.col("citation"), F.col("framework_code"), F.col("version_label")).alias("cite"), version_status(F.col("is_current")).alias("version_status"), "score")


def reduced(rows: DataFrame, columns: Sequence[str] = ("content", "context_prefix", "body", "title_original", "amendment_body")) -> DataFrame:
    """rows with licensed text blanked; what is there at all stays."""
    return rows.withColumns({c: F.lit("") for c in columns if c in rows.columns})


def gaps(hits: int, framework: str, version: str, known: dict[str, list[str]]) -> list[dict]:
    """What stands between a search and its answer; a filter's gap blocks only where nothing was found."""
    out = []
    if framework and framework not in known:
        out.append({"kind": "unknown_framework", "blocks": not hits})
    elif framework and version and version not in known[framework]:
        out.append({"kind": "version_not_found", "blocks": not hits})
    if not hits:
        out.append({"kind": "no_evidence", "blocks": True})
    return out
