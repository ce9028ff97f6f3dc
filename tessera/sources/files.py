"""Files of an ingest: scans with digests, registry and golden tables, vectors from an external embedder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a golden table.
GOLDEN = "id string, question string, framework_code string, version_label string, citation_norm string, expect_abstain string, expect_fail string, notes string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, sha256, size_bytes of every file under root, through any store Spark reads; version-control folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    found = files.select(rel.alias("rel_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    return found.filter(~F.col("rel_path").rlike(r"(^|/)\.git/"))


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry table; a ragged row is an error."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cases (case_id, question, expect_abstain, expect_fail, notes), expected (case_id and a citation's keys), and rejected rows.

    Rows of one id are one case, its first row's values holding; a golden table is small and in one file, hence the
    line numbers. Rejected: without id or question, or a case that neither abstains nor expects anything.
    """
    raw = spark.read.csv(path, schema=GOLDEN, header=True, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    rows = raw.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in raw.columns]).withColumn("line", F.monotonically_increasing_id())
    yes = lambda c: F.col(c).isin("true", "1")
    bad = (F.col("id") == "") | (F.col("question") == "")
    good = rows.filter(~bad)
    first = F.min_by(F.struct("question", yes("expect_abstain").alias("expect_abstain"), yes("expect_fail").alias("expect_fail"), "notes"), "line")
    cases = good.groupBy(F.col("id").alias("case_id")).agg(first.alias("c")).select("case_id", "c.*")
    expected = good.filter("framework_code <> '' and citation_norm <> ''").select(F.col("id").alias("case_id"), "framework_code", "version_label", "citation_norm")
    aimless = cases.filter("not expect_abstain").join(expected.select("case_id"), "case_id", "left_anti").select(F.col("case_id").alias("id"), F.lit("expects nothing").alias("why"))
    return cases, expected, rows.filter(bad).select("id", F.lit("no id or question").alias("why")).unionByName(aimless)


def latest_captures(captures: DataFrame, kind: str) -> DataFrame:
    """The last capture of a kind for each path; a path without one is deferred, not an error."""
    last = F.row_number().over(Window.partitionBy("rel_path").orderBy(F.desc("id")))
    return captures.filter(F.col("kind") == kind).withColumn("__n", last).filter("__n = 1").drop("__n")


def write_texts(chunks: DataFrame, path: str) -> None:
    """index and text as JSON lines, for an external embedder."""
    chunks.select(F.col("id").alias("index"), "text").write.json(path)


def read_vectors(spark: SparkSession, path: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """index and embedding as an external embedder returned them, and those that it may not have: of other dimensions, or an index twice."""
    raw = spark.read.schema("index long, embedding array<float>").json(path)
    n = raw.groupBy("index").agg(F.count("*").alias("n"))
    held = raw.join(n, "index").withColumn("why", F.when(F.coalesce(F.size("embedding"), F.lit(-1)) != dims, "dimensions").when(F.col("n") > 1, "twice"))
    return held.filter("why is null").select("index", "embedding"), held.filter("why is not null").select("index", "why")
