"""Batches of a stream into a table, each once: a ledger has the numbers of those that are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEDGER = "batch long, rows long"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def written(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows): the batches that a table under ``folder`` has whole."""
    path = f"{folder.rstrip('/')}/ledger"
    return spark.read.schema(_LEDGER).parquet(path) if _there(spark, path) else spark.createDataFrame([], _LEDGER)


def rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table's rows, of the ledger's batches alone: what a batch that never ended has left isn't among them."""
    path = f"{folder.rstrip('/')}/rows"
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, batch long").parquet(path)
    return found.join(F.broadcast(written(spark, folder).select("batch")), "batch", "left_semi").drop("batch")  # a number for each batch


def once(folder: str) -> Callable[[DataFrame, int], None]:
    """STM-01 to 03: a handler of batches that writes each number's rows once. A batch that stopped half-way is written anew in its own
    place; one that the ledger has is left alone."""
    root = folder.rstrip("/")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if written(spark, root).filter(F.col("batch") == number).limit(1).count():
            return
        path = f"{root}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        count = spark.read.schema(batch.schema).parquet(path).count()
        spark.createDataFrame([(number, count)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{root}/ledger")

    return handle
