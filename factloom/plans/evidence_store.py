"""Stored observations and the evidence that follows from them, in partitions by company (SNK-02, SNK-04, ER-13).

Both tables are dealt out by a hash of company_id into the same numbered partitions. New observations are appended; evidence is computed
again for the companies they touch alone, from the partitions these are in, and only those partitions are replaced.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evidence
from factloom.operators.cut import cut, let_go
from factloom.plans import ingest

#: Partitions of a new store.
PARTS = 64


def part_of(parts: int, company: str = "company_id") -> Column:
    return F.pmod(F.xxhash64(company), F.lit(parts)).cast("int")


class EvidenceStore:
    """Tables ``observations``, ``evidence`` and ``companies`` under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _place(self, path: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _there(self, name: str) -> bool:
        system, place = self._place(self._path(name))
        return system.exists(place)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name)).drop("part")

    def add(self, observations: DataFrame) -> None:
        """SNK-01: a batch of observations, each in its company's partition."""
        rows = observations.withColumn("part", part_of(self.parts))
        rows.repartition("part").write.mode("append").partitionBy("part").parquet(self._path("observations"))

    def _replace(self, name: str, fresh: DataFrame, ids: DataFrame, touched: list[int]) -> None:
        """SNK-02: ``fresh`` rows for those of companies ``ids``, in the partitions ``touched``; no other file is written."""
        new = fresh.withColumn("part", part_of(self.parts))
        if self._there(name):
            old = self.spark.read.parquet(self._path(name)).filter(F.col("part").isin(touched))
            new = old.join(ids, "company_id", "left_anti").unionByName(new)
        else:  # a file without rows keeps the columns of a table that loses all of its
            fresh.limit(0).write.parquet(f"{self._path(name)}/part=-1")
        new = cut(new, name)  # as its partitions are read from what they replace
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self._path(name))
        left = {r.part for r in new.select("part").distinct().collect()}  # at most as many as there are partitions
        for part in set(touched) - left:
            system, place = self._place(f"{self._path(name)}/part={part}")
            system.delete(place, True)
        let_go(new)

    def reprocess(self, ids: DataFrame, sources: DataFrame, now: datetime) -> None:
        """ER-13, SNK-04: evidence and confidence of companies ``ids`` (company_id) anew, from their stored observations. Those that have
        none lose their rows; doing it again changes nothing."""
        ids = cut(ingest.touched(ids), "touched")
        touched = sorted(r.part for r in ids.select(part_of(self.parts).alias("part")).distinct().collect())  # as above
        stored = self.spark.read.parquet(self._path("observations")).filter(F.col("part").isin(touched)).drop("part").join(ids, "company_id", "left_semi")
        scores = cut(evidence.scored(stored, sources, now), "scores")
        rolled = cut(evidence.roll_up(scores), "rolled")
        self._replace("evidence", rolled, ids, touched)
        self._replace("companies", evidence.company_confidence(rolled, scores), ids, touched)
        for table in (scores, rolled, ids):
            let_go(table)

    def ingest(self, observations: DataFrame, sources: DataFrame, now: datetime) -> None:
        """A batch of observations, and evidence for the companies it touches."""
        observations = cut(observations, "batch")
        self.add(observations)
        self.reprocess(observations.select("company_id"), sources, now)
        let_go(observations)


def bucketed(observations: DataFrame, name: str, path: str, buckets: int = PARTS) -> DataFrame:
    """JN-01, JN-09, AGG-01: observations as a table of the catalogue, in buckets by company_id: roll-up, company confidence and their
    join find each company's rows together, so none of them shuffles."""
    observations.write.mode("overwrite").format("parquet").bucketBy(buckets, "company_id").sortBy("company_id").option("path", path).saveAsTable(name)
    return observations.sparkSession.table(name)
