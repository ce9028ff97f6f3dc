"""What several operators share: reading tables, durable intermediate tables, words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import delete, durable, scratch, shared_dir, spread

__all__ = ["SPACE", "delete", "durable", "lower_ascii", "scratch", "shared_dir", "table", "words"]

#: Fixed value: what separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def words(text: Column) -> Column:
    """The words of a text, `[^\\x20\\x09-\\x0D]+`; none if it is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
