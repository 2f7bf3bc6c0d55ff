"""Writes (SNK-01..10): tables are appended to, or replaced by a new version of the parts that change."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_observations(observations: DataFrame, path: str, collected_at: datetime) -> None:
    """SNK-01: a batch, all of one time, by source. Rows of a source come together first, so that there are about as many files as sources,
    not as many from each task; a source of very many rows is dealt over several tasks."""
    observations.withColumn("collected_at", F.lit(collected_at)).hint("rebalance", "source_id").write.mode("append").partitionBy("source_id").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK-02: ``new`` in place of the rows of ``old`` with its keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SNK-08: a child table without the rows of deleted parents."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def patched(base: DataFrame, patch: DataFrame, key: str, columns: list[str], named: str | None = None) -> DataFrame:
    """SNK-09: what a patch sets, over what was. ``named``: the patch's array of the columns that it sets, to null too; without
    it, all that aren't null."""
    given = patch.select(key, *(F.col(c).alias(f"__{c}") for c in columns), *([F.col(named).alias("__set")] if named else []))
    joined = base.join(given, key, "left")
    new = {c: F.when(F.array_contains("__set", c), F.col(f"__{c}")).otherwise(F.col(c)) if named else F.coalesce(f"__{c}", c) for c in columns}
    return joined.withColumns(new).drop(*(f"__{c}" for c in columns), "__set")


def split_bad(rows: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """SNK-06: rows that can be taken, and the others; one bad row stops nothing."""
    marked = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return marked.filter("ok").drop("ok"), marked.filter("NOT ok").drop("ok")


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK-07."""
    rows.write.mode("overwrite").csv(path, header=True)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """SNK-10: of a file: its name, size and SHA-256, as entries for its observations' metadata."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.create_map(F.lit("source_file"), name, F.lit("sha256"), F.sha2("content", 256), F.lit("bytes"), F.col("length").cast("string")).alias("metadata"))


def with_provenance(observations: DataFrame, provenance: Column) -> DataFrame:
    """SNK-10: a file's entries in its observations' metadata, over older ones of the same name."""
    old = F.col("metadata") if "metadata" in observations.columns else F.create_map().cast("map<string,string>")
    old = F.coalesce(old, F.create_map().cast("map<string,string>"))
    return observations.withColumn("metadata", F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(provenance, k)), provenance))


def write_all(tables: dict[str, DataFrame], folder: str, dry_run: bool = False) -> dict[str, int]:
    """SNK-05: writes each table under ``folder``, or, in a dry run, only counts its rows."""
    counts = {}
    for name, table in tables.items():
        if not dry_run:
            table.write.mode("append").parquet(f"{folder.rstrip('/')}/{name}")
        counts[name] = table.count()
    return counts
