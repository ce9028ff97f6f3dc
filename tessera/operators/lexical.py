"""BM25: statistics and weights of terms, hashed document vectors, top-k. asked_index() writes its table when it is called; all else only plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.functions.tokens import dimension, query_tokens, tokens

K1, B = 1.2, 0.75
TOP_K = 50
DECIMALS = 6


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, dl, terms: each row's number of tokens, and its distinct ones with their counts, (term, tf), in order. Counts are run lengths of the sorted tokens, so that no row leaves its task."""

    def runs(held):
        starts = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        term = lambda begin: lambda i, k: F.struct(F.get(held, i).alias("term"), (F.coalesce(F.get(begin, k + 1), F.size(held)) - i).cast("int").alias("tf"))
        return F.get(F.transform(F.array(starts), lambda begin: F.transform(begin, term(begin))), F.lit(0))

    of = lambda held: F.struct(F.size(held).alias("dl"), F.when(F.size(held) > 0, runs(held)).alias("terms"))
    found = F.get(F.transform(F.array(F.array_sort(tokens(F.col(text)))), of), F.lit(0))  # the tokens are bound once
    return docs.select(key, found.alias("__counted")).select(key, "__counted.dl", "__counted.terms")


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, dl of every row, in one pass over the text without a shuffle. A text without tokens has no row."""
    each = counted(docs, key, text).select(key, "dl", F.explode_outer("terms").alias("t")).filter("t is not null")
    return each.select(key, "t.term", "t.tf", "dl")


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n and avgdl, which is 1 where there is no token. Texts without tokens count among n."""
    return _statistics(docs.select(F.size(tokens(F.col(text))).alias("dl")))


def _statistics(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count("*").alias("n"), F.sum("dl").alias("total")).select("n", _mean_length())


def _mean_length() -> Column:
    return F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0).alias("avgdl")


def term_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n and avgdl of corpus_statistics(), terms, how many there are, and most, how many documents the most frequent one is in (null without any).

    One pass over the text, from which only the terms of each task leave it. A null beside a text's distinct tokens stands for the text itself.
    """
    held = docs.select(tokens(F.col(text)).alias("tokens"))
    each = held.select(F.size("tokens").alias("dl"), F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
    whole = F.col("term").isNull()
    counts = each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(whole, F.col("dl"))).alias("total"))
    sums = counts.agg(F.coalesce(F.sum(F.when(whole, F.col("df"))), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.count("term").alias("terms"), F.max(F.when(~whole, F.col("df"))).alias("most"))
    return sums.select("n", _mean_length(), "terms", "most")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The lexical index, (key, term, tf, dl), written as a table so that the text is read once, and n and avgdl in one row."""
    tf = durable(term_frequencies(docs, key, text), "lexical-index")
    n, total = docs.agg(F.count("*").alias("n")), tf.agg(F.sum("tf").alias("total"))
    stats = n.crossJoin(F.broadcast(total)).select("n", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0).alias("avgdl"))
    return tf, stats


def asked_index(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, dl, terms: every document's length, and those of its tokens that one query asks for; written, so that the text is read once."""
    split = docs.select(key, tokens(F.col(text)).alias("tokens")).select(key, F.size("tokens").alias("dl"), "tokens")
    return durable(split.select(key, "dl", F.filter("tokens", lambda t: t.isin(*terms)).alias("terms")), "asked-index")


def weights(tf: DataFrame, stats: DataFrame, key: str = "doc_id", df: DataFrame | None = None) -> DataFrame:
    """key, term, dim, w: BM25 weights of a table (key, term, tf, dl). Where terms are few, Spark broadcasts their frequencies; a frequent term's rows may be split. df: (term, df), if it is known."""
    df = (document_frequencies(tf) if df is None else df).withColumn("dim", dimension(F.col("term")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(df, "term").crossJoin(F.broadcast(stats)).select(key, "term", "dim", weight.alias("w"))


def asked_weights(asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """weights() of an asked_index(), statistics being those of all documents."""
    tf = asked.select(key, "dl", F.explode("terms").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))
    return weights(tf, _statistics(asked), key)


def term_weights(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, dim, w: the BM25 weight of every term of every document, statistics being those of all documents."""
    return weights(*index(docs, key, text), key)


def document_vectors(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, dim, w: weights summed by hashed dimension, so that terms that collide add up."""
    return weights.groupBy(key, "dim").agg(F.sum("w").alias("w"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """key, term: distinct terms of each query, stopwords dropped."""
    return queries.select(key, F.explode(query_tokens(F.col(text))).alias("term"))


def score(weights: DataFrame, asked: DataFrame, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """query, key, score over 0, rounded, for every document that has a term of the query."""
    scored = weights.join(asked, "term").groupBy(query, key).agg(F.round(F.sum("w"), DECIMALS).alias("score"))
    return scored.filter("score > 0")


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """The distinct terms of one query."""
    return spark.range(1).select(query_tokens(F.lit(query))).first()[0]


def top_k(docs: DataFrame, query: str, k: int = TOP_K, within: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of the k best documents for one query, ties to the smaller key. within: (key), those that may be found."""
    return best(asked_weights(asked_index(docs, terms_of(docs.sparkSession, query), key, text), key), k, within, key)


def best(held: DataFrame, k: int = TOP_K, within: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """top_k() over weights of the query's terms, which several arms may share."""
    if within is not None:
        held = held.join(within.select(key).distinct(), key, "left_semi")
    scored = held.groupBy(key).agg(F.round(F.sum("w"), DECIMALS).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)
