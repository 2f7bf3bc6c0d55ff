"""Text files whose rows keep their place: numbers over all splits of a file, and lines that fit no columns set apart (SRC-01, SRC-09, SNK-06)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.cut import cut

FILE, ROW = "file", "row"
_BAD, _START, _AT = "__bad", "__start", "__at"


@dataclass(frozen=True)
class Numbered:
    """rows: the columns of the files, with ``file`` and ``row`` from 0; rejects: (file, row, line), numbered among all."""

    rows: DataFrame
    rejects: DataFrame


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (file, __start of their split, __at in order of reading) with their number in the file: what is in the splits before, and their
    place in their own. Splits are counted, not sorted: a row moves nowhere but to its split's count."""
    splits = rows.groupBy(FILE, _START).agg(F.count("*").alias("n"), F.min(_AT).alias("first"))
    before = Window.partitionBy(FILE).orderBy(_START).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(FILE, _START, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = rows.join(splits, [FILE, _START]).withColumn(ROW, F.col("before") + F.col(_AT) - F.col("first"))
    return out.drop("before", "first", _START, _AT)


def read_numbered(spark: SparkSession, path: str) -> Numbered:
    """CSV files of one header, a line a row, read once. Empty lines aren't counted; a line with more or fewer cells than the header has is
    rejected, and stops nothing."""
    names = [c.lstrip("﻿") for c in spark.read.csv(path, header=True, quote='"', escape='"').columns]
    schema = ", ".join(f"`{c}` string" for c in [*names, _BAD])
    options = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    raw = spark.read.schema(schema).options(**options).csv(path)
    place = (F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(_START), F.monotonically_increasing_id().alias(_AT))
    read = cut(raw.select(*(F.col(f"`{c}`") for c in [*names, _BAD]), *place), "numbered")  # numbers hold for this reading alone
    rows = numbered(read)
    return Numbered(rows.filter(F.col(_BAD).isNull()).drop(_BAD), rows.filter(F.col(_BAD).isNotNull()).select(FILE, ROW, F.col(_BAD).alias("line")))
