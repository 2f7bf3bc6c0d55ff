"""Registered queries that replay the driver's tables as files that arrive, batch after batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import health
from factloom.operators.cut import scratch
from factloom.plans.bridge import Tables
from factloom.plans.catalogue import query
from factloom.streaming import file_drop, ledger, rate_limits

#: Drops of files in a replay.
DROPS = 4


def replayed(rows: DataFrame, order: str, folder: str, arrived: Callable[[], None], drops: int = DROPS, again: float = 0.0) -> None:
    """Writes ``rows`` to ``folder`` in drops by the number ``order``, calling ``arrived`` after each. Each drop repeats what lies within
    ``again`` before its begin, as a source does that sends its last files twice."""
    cuts = [float("-inf"), *rows.approxQuantile(order, [i / drops for i in range(1, drops)], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:], strict=False):
        rows.filter((F.col(order) > low - again) & (F.col(order) <= high)).drop(order).write.mode("append").parquet(folder)
        arrived()


_CALLS = """calls AS (SELECT source_id, call_id, micros, limit_per_minute, row_number() OVER (PARTITION BY source_id ORDER BY micros, call_id) AS n
    FROM (SELECT source_id % 40 AS source_id, job_id AS call_id, epoch_us(created_at) // 500 AS micros, 1 + source_id % 40 % 5 AS limit_per_minute FROM jobs))"""
_ALLOWED = f"""WITH RECURSIVE {_CALLS}, fold AS (
    SELECT source_id, call_id, n, true AS allowed, [micros] AS held FROM calls WHERE n = 1 UNION ALL
    SELECT source_id, call_id, n, len(still) < limit_per_minute, CASE WHEN len(still) < limit_per_minute THEN list_append(still, micros) ELSE still END FROM (
      SELECT c.*, list_filter(f.held, lambda h: h > c.micros - 60000000) AS still FROM fold f JOIN calls c ON c.source_id = f.source_id AND c.n = f.n + 1))
    SELECT source_id, call_id, allowed FROM fold"""


def _calls(t: Tables) -> DataFrame:
    """A month's jobs as calls of forty sources within an hour or two, with limits of one to five a minute."""
    source = F.col("source_id") % 40
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 500))
    return t.view("jobs").select(source.alias("source_id"), at.alias("at"), (1 + source % 5).cast("int").alias("limit_per_minute"), F.col("job_id").alias("call_id"))


@query(_ALLOWED, "jobs")
def rate_limited_by_source(t: Tables) -> DataFrame:
    """WIN-08, STM-04, at limits of one to five calls."""
    return health.allowed_calls(_calls(t))


@query(_ALLOWED, "jobs")
def rate_limited_stream(t: Tables) -> DataFrame:
    """STM-04: the same calls as files that arrive in drops, each source's last minute held as the stream's state."""
    folder, out, checkpoint = (scratch(t.spark, f"calls-{x}") for x in ("in", "out", "state"))

    def arrived() -> None:
        file_drop.run_available(rate_limits.allowed(rate_limits.calls(t.spark, folder)), checkpoint, ledger.once(out)).awaitTermination()

    replayed(_calls(t).withColumn("order", F.unix_micros("at").cast("double")), "order", folder, arrived)
    return ledger.rows(t.spark, out, "source_id long, call_id long, allowed boolean")


@query("SELECT obs_id, company_id, source_id, field, value, verification_type, epoch_us(collected_at) AS collected_at FROM observations GROUP BY ALL", "observations")
def streamed_observations(t: Tables) -> DataFrame:
    """STM-01 to 03: observations that arrive in drops, each of which repeats the last month of the one before; and the last batch is
    handed over twice."""
    folder, out, checkpoint = (scratch(t.spark, f"observations-{x}") for x in ("in", "out", "state"))
    handle, day = ledger.once(out), 86400.0

    def arrived() -> None:
        def twice(batch: DataFrame, number: int) -> None:
            handle(batch, number)
            handle(batch, number)

        file_drop.run_available(file_drop.observations(t.spark, folder, "60 days"), checkpoint, twice).awaitTermination()

    rows = t.view("observations").withColumn("collected_at", F.col("collected_at").cast("timestamp")).withColumn("order", F.unix_seconds("collected_at").cast("double"))
    replayed(rows, "order", folder, arrived, again=30 * day)
    found = ledger.rows(t.spark, out, file_drop.OBSERVATION)
    return found.select("obs_id", "company_id", "source_id", "field", "value", "verification_type", F.unix_micros("collected_at").alias("collected_at"))
