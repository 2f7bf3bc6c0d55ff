"""Rate limits on a stream of calls: each source's state is the last minute's allowed calls, and goes when they are too old."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.health import RATE_WINDOW_SECONDS

CALL = "source_id long, at timestamp, limit_per_minute int, call_id long"
_SPAN = int(RATE_WINDOW_SECONDS * 1_000_000)


def calls(spark: SparkSession, path: str, kind: str = "parquet", most_files: int = 1000) -> DataFrame:
    """Calls of files in a folder; ``most_files`` bounds what a batch, and so a source's calls in one, can hold."""
    return spark.readStream.schema(CALL).option("maxFilesPerTrigger", most_files).format(kind).load(path)


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    batch = pd.concat(parts).sort_values(["micros", "call_id"])
    held = deque(state.get[0]) if state.exists else deque()
    out = []
    for at, limit in zip(batch["micros"].tolist(), batch["limit_per_minute"].tolist(), strict=True):
        while held and held[0] <= at - _SPAN:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(at)
    if held:
        state.update((list(held),))
        gone = held[-1] // 1000 + _SPAN // 1000 + 1
        state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"source_id": key[0], "call_id": batch["call_id"].to_numpy(), "allowed": out})


def allowed(stream: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """WIN-08, STM-04: each call (of CALL) with whether fewer than its limit were allowed within the sixty seconds before.

    Calls come in the order of time from batch to batch; within one they are put in order. What is older than ``lateness`` behind the
    latest call of earlier batches is too late and left out."""
    rows = stream.withWatermark("at", lateness).select("source_id", "at", F.unix_micros("at").alias("micros"), "limit_per_minute", "call_id")
    return rows.groupBy("source_id").applyInPandasWithState(_fold, "source_id long, call_id long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)
