"""Dense numbers for the rows of a table of any size, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.durable import durable


def dealt(rows: DataFrame, order: list[str | Column], name: str = "id", first: int = 1) -> DataFrame:
    """rows with numbers from `first` on in their order, without gaps; rows that the order does not tell apart are numbered as they come.

    Rows are sorted by ranges and written; a row's place in its range, after the sizes of the ranges before, is its
    number. The driver adds up one size for each range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "dealt")
    part = F.shiftrightunsigned("__place", 33)
    sizes, before = {}, first
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        sizes[r.part], before = before, before + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in sizes.items() for x in pair]), part) if sizes else F.lit(first)
    return placed.withColumn(name, (start + F.col("__place").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__place")


def with_ids(controls: DataFrame, first: int = 1) -> DataFrame:
    """A document's controls as rows to insert: id, dealt in order of document_id and ordinal, and parent_control_id in place of parent_norm.

    A norm that a document has twice is an error that names it, since its children would have two parents. A parent that
    the document lacks is null. controls: document_id, ordinal, citation_norm, parent_norm.
    """
    twice = controls.groupBy("document_id", "citation_norm").agg(F.count("*").alias("n")).filter("n > 1").orderBy("document_id", "citation_norm").first()
    if twice:
        raise ValueError(f"document {twice.document_id} has {twice.citation_norm!r} {twice.n} times")
    held = dealt(controls, ["document_id", "ordinal", "citation_norm"], "id", first)
    parents = held.select("document_id", F.col("citation_norm").alias("parent_norm"), F.col("id").alias("parent_control_id"))
    return held.join(parents, ["document_id", "parent_norm"], "left").drop("parent_norm")
