"""The lexical index as a stored table that batches keep up to date.

Three tables, published together, that only grow; every row bears a sign, and what counts is the sum:

- forward: a document's length and its terms with their counts, as its task has found them. A batch finds here what its
  documents said before.
- postings: a row for each term of each document, in a folder for each bucket of terms. A query reads the folders of its
  terms' buckets, and no text.
- terms and totals: how documents, frequencies and lengths change with each batch.

A batch of changed and removed documents adds their old rows with sign -1 and their new ones with sign 1, so that sums
over all batches are those of an index built anew. compact() writes the sums as one batch.

Text is tokenised once, and a text's counts are taken within its row, so that building shuffles postings once, to their
buckets. A frequent term's postings are dealt over several files of its bucket,
as many as keep a file to a bounded number of them; a file is in order of terms, so that a query skips most of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import durable
from tessera.operators import lexical, lexical_many
from tessera.published import Published

#: Folders of postings, files of a folder at least, and postings of a file, which one task sorts, at most about.
BUCKETS, FILES, POSTINGS = 32, 4, 500_000


class LexicalStore:
    """A store under root. buckets: how many folders a batch's postings are parted in, the more the larger the corpus; a store keeps to the number that it was built with."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.published, self.buckets = spark, Published(spark, root), buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return self.published.version() > 0

    def build(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> int:
        """The first version, of all documents; keys are unique."""
        return self._add(lexical.counted(docs, key, text).select(F.col(key).alias("key"), "dl", "terms", F.lit(1).alias("sign")), 0)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> int:
        """The next version, after new and changed documents (key, text) and removed ones (key). A key that is in both is changed."""
        after = self.published.version()
        new = lexical.counted(changed, key, text).select(F.col(key).alias("key"), "dl", "terms")
        touched = changed.select(F.col(key).alias("key"))
        if removed is not None:
            touched = touched.unionByName(removed.select(F.col(key).alias("key")))
        touched = durable(touched.distinct(), "lexical-keys")
        old = self._standing(self._forward().join(touched.hint("shuffle_hash"), "key", "left_semi"))  # keys are kept in memory, and no document is sorted
        old = old.withColumn("sign", (-F.col("sign")).cast("int"))
        return self._add(old.select("key", "dl", "terms", "sign").unionByName(new.withColumn("sign", F.lit(1))), after)

    def compact(self) -> int:
        """The next version: the same index as one batch."""
        after = self.published.version()
        held = self._standing(self._forward()).withColumn("sign", F.col("sign").cast("int"))
        return self._add(held.select("key", "dl", "terms", "sign"), after, anew=True)

    def _forward(self) -> DataFrame:
        return self.published.read("forward")

    def _standing(self, rows: DataFrame) -> DataFrame:
        """Those of the forward rows that count. Of a single batch all do."""
        if len(self.published.listed()["forward"]) > 1:
            rows = rows.groupBy("key", "dl", "terms").agg(F.sum("sign").alias("sign")).filter("sign <> 0")
        return rows

    def _add(self, delta: DataFrame, after: int, anew: bool = False) -> int:
        kept = {} if anew else self.published.listed(after)
        forward = self.published.write("forward", delta)
        held = self.published.written("forward", forward)
        each = held.select("key", F.explode_outer("terms").alias("t"), "dl", "sign").filter("t is not null")
        # what a term says of a document is one number on its way to its bucket
        said = F.shiftleft(F.col("t.tf").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("dl").cast("long"), 1)).bitwiseOR((F.col("sign") > 0).cast("long"))
        n = held.agg(F.sum(F.greatest(F.size("terms"), F.lit(0)))).first()[0] or 0
        files = max(FILES, -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets), -(-n // (self.buckets * POSTINGS)))
        # A task for each file: hashed, several files of a few buckets would meet in one task.
        place = self._bucket(F.col("term")) * files + F.pmod(F.xxhash64("key"), F.lit(files)).cast("int")
        dealt = each.select("key", "t.term", said.alias("said")).repartitionById(self.buckets * files, place).withColumn("bucket", self._bucket(F.col("term")))
        sign = F.when(F.col("said") % 2 == 1, 1).otherwise(-1)
        dealt = dealt.sortWithinPartitions("bucket", "term").select("key", F.shiftright("said", 1).bitwiseAND((1 << 32) - 1).cast("int").alias("dl"), sign.alias("sign"), "term", F.shiftright("said", 33).cast("int").alias("tf"), "bucket")
        written = {"forward": forward, "postings": self.published.write("postings", dealt, ["bucket"])}
        postings = self.published.written("postings", written["postings"])
        written["terms"] = self.published.write("terms", postings.groupBy("bucket", "term").agg(F.sum("sign").alias("df")).filter("df <> 0"))
        written["totals"] = self.published.write("totals", held.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("total")))
        return self.published.publish({name: [*kept.get(name, []), path] for name, path in written.items()}, after)

    def statistics(self) -> DataFrame:
        """One row: n and avgdl, which is 1 where there is no token."""
        sums = self.published.read("totals").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return sums.select("n", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0).alias("avgdl"))

    def frequencies(self) -> DataFrame:
        """term, df."""
        return self.published.read("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def postings(self, key: str = "doc_id") -> DataFrame:
        """key, term, tf, dl of all documents."""
        return self._live(self.published.read("postings"), key)

    def _live(self, rows: DataFrame, key: str) -> DataFrame:
        if len(self.published.listed()["postings"]) > 1:
            rows = rows.groupBy("key", "term", "tf", "dl").agg(F.sum("sign").alias("sign")).filter("sign > 0")
        return rows.select(F.col("key").alias(key), "term", "tf", "dl")

    def asked(self, terms: Sequence[str], key: str = "doc_id") -> DataFrame:
        """key, term, dim, w: weights of one query's terms, from their buckets' folders."""
        if not terms:
            return lexical.weights(self.postings(key).limit(0), self.statistics(), key)
        buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t")).alias("b")).distinct().collect()]
        rows = self.published.read("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))
        df = self.published.read("terms").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms))).groupBy("term").agg(F.sum("df").alias("df"))
        return lexical.weights(self._live(rows, key), self.statistics(), key, df)

    def asked_many(self, terms: DataFrame, key: str = "doc_id") -> DataFrame:
        """key, term, dim, w: weights of the terms of many queries, a table (term) that is joined, however large."""
        wanted = terms.select("term").distinct()
        rows = self.published.read("postings").join(wanted, "term", "left_semi")
        df = self.published.read("terms").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        return lexical.weights(self._live(rows, key), self.statistics(), key, df)

    def best_many(self, terms: DataFrame, arms: Mapping[int, lexical_many.Arm], queries: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
        """The best documents of many queries, from what each document holds: lexical_many.best_many()."""
        return lexical_many.best_many(self._standing(self._forward()), self.frequencies(), self.statistics(), terms, arms, queries, docs)
