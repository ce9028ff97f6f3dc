"""Tables in the folder that the driver and all executors share: where lineage is cut, and work is kept that is read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, it is a temporary one, as in tests, and an error on a cluster, whose machines share none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Of each scratch() that is open, the tables written in it.
_scopes: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table in any store that Spark reads."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that durable() writes within are deleted at the end. What is built on them has to be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table of texts as it is read, dealt over all cores where its files do not do so themselves, as one large row group does not.

    Files as many as cores are taken as they are; of fewer, a count of the tasks that find rows tells.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if len(table.inputFiles()) >= cores or table.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return table
    return table.repartition(cores)
