"""Files that arrive in a folder, as streams: observations without repeats, counts by time, and batches into tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OBSERVATION = "obs_id string, company_id long, source_id long, field string, value string, verification_type string, collected_at timestamp"


def observations(spark: SparkSession, path: str, lateness: str = "1 day", kind: str = "parquet") -> DataFrame:
    """STM-02: each observation once; what comes later than ``lateness`` is dropped, so the state is bounded."""
    rows = spark.readStream.schema(OBSERVATION).format(kind).load(path)
    return rows.withWatermark("collected_at", lateness).dropDuplicatesWithinWatermark(["obs_id"])


def counts(stream: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Observations by source and window of time."""
    span = F.window("collected_at", width, slide) if slide else F.window("collected_at", width)
    return stream.groupBy(span, "source_id").agg(F.count("*").alias("observations"))


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """STM-01: one run over what there is, batch by batch; a batch's number lets ``handle`` write it once."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
