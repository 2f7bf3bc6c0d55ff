"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows, and bytes of long values, that Python takes at once, which bounds a worker's memory; a longer value comes alone.
ROWS, BYTES = 256, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a local one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def let_go(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._written_to
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in stretches of at most ``ROWS`` rows and about ``BYTES`` bytes."""
    if not batch.num_rows:
        return
    if batch.nbytes <= BYTES:
        cuts = list(range(0, batch.num_rows, ROWS))
    else:
        size = np.full(batch.num_rows, 8, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            elif column.nbytes:
                size += column.nbytes // batch.num_rows
        cuts, held = [], BYTES
        for i, n in enumerate(size.tolist()):
            if held + n > BYTES or i - cuts[-1] >= ROWS:
                cuts.append(i)
                held = 0
            held += n
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Returns freed memory to the system: a worker is kept for later tasks, of other stages too, and would hold it beside theirs."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(
    df: DataFrame, schema: T.StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]
) -> DataFrame:
    """mapInArrow with ``fn``, which gets batches in portions, yielding dicts of columns, given in the order of ``schema``."""
    return map_whole(df, schema, lambda batches: fn(part for b in batches for part in portions(b)))


def map_whole(
    df: DataFrame, schema: T.StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]
) -> DataFrame:
    """map_batches() with batches as they come, for rows of a bounded size."""
    arrow = to_arrow_schema(schema)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        yield from fn(batches)
        give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in given(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


def extend(
    df: DataFrame, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], dict], used_up: tuple[str, ...] = ()
) -> DataFrame:
    """``df`` with the columns of ``schema`` behind its own; ``fn`` makes them for each batch.

    A column of ``df`` with one of the new names gives way to the new one; so do those ``used_up``, which only ``fn``
    sees, so that long texts needn't come back from Python."""
    new = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    gone = set(new.names) | set(used_up)
    old = [c for c in df.columns if c not in gone]
    kept = df.select(*(F.col(f"`{c}`") for c in old))
    out = T.StructType([*kept.schema.fields, *new.fields])

    seen_only = [c for c in df.columns if c not in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made = fn(batch)
            yield {n: batch.column(i) for i, n in enumerate(old)} | {n: made[n] for n in new.names}

    return map_batches(df.select(*(F.col(f"`{c}`") for c in [*old, *seen_only])), out, run)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as str, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]
