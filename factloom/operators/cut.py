"""Where a long lineage ends, and where files go meanwhile."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share; in a local session without one, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the folder of scratch(), so that what builds on it neither computes it again nor loses it with an executor."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def let_go(df: DataFrame) -> None:
    """Deletes a table of cut() that nothing reads any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
