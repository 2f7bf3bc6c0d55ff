"""Reports over sources, jobs and imports (AGG-06..14, JN-02/03/08/11, WIN-03/04/07/08, STM-01..08, SRT-04)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text, values

# The window of the rate limit, and the list's bounds.
RATE_WINDOW_SECONDS, JOB_PAGE, LARGEST_JOB_PAGE = 60.0, 50, 500


def display_name(sources: DataFrame) -> Column:
    """PRJ-06: the display name, or the name where that is missing or empty."""
    return F.coalesce(F.nullif(sources["display_name"], F.lit("")), sources["name"])


def source_names(links: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """AGG-06, AGG-07: sorted names of the distinct sources behind each company or piece of evidence. Two sources of one
    name both appear. Links are made distinct before names are joined."""
    named = sources.select("source_id", display_name(sources).alias("shown"))
    rows = links.select(*by, "source_id").distinct().join(named, "source_id")
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list("shown")).alias("sources"))


def source_health(jobs: DataFrame) -> DataFrame:
    """AGG-08, WIN-03: per source: jobs, records, its last run, last success and last error. One aggregate, no sort."""
    newest = F.struct("created_at", "job_id")
    of = lambda status: F.when(F.col("status") == status, newest)
    return jobs.groupBy("source_id").agg(
        F.count("*").alias("total_jobs"),
        F.sum("records_updated").alias("records_total"),
        F.max_by("status", newest).alias("last_status"),
        F.max_by("started_at", newest).alias("last_run_at"),
        F.max_by("finished_at", of("success")).alias("last_success_at"),
        F.max_by("error_summary", of("failed")).alias("last_error"),
    )


def health_of_all(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-11: sources without jobs too, by name."""
    out = sources.select("source_id", display_name(sources).alias("shown")).join(source_health(jobs), "source_id", "left")
    return out.withColumns({"total_jobs": F.coalesce("total_jobs", F.lit(0)), "records_total": F.coalesce("records_total", F.lit(0))})


def job_list(jobs: DataFrame, status: str | None = None, limit: int = JOB_PAGE) -> DataFrame:
    """STM-08."""
    if not 1 <= limit <= LARGEST_JOB_PAGE:
        raise ValueError("limit is beyond 1 to 500")
    found = jobs.filter(F.col("status") == status) if status else jobs
    return found.orderBy(F.desc("created_at"), F.asc("job_id")).limit(limit)


def job_roll_up(results: DataFrame, by: list[str]) -> DataFrame:
    """AGG-12, STM-06: records by outcome, and what that makes of the job."""
    out = results.groupBy(*by).agg(
        F.count("*").alias("discovered"), F.count_if(F.col("ok")).alias("updated"), F.count_if(~F.col("ok")).alias("failed")
    )
    return out.withColumn("status", F.when(F.col("failed") == 0, "success").otherwise("partial"))


def idempotent(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """STM-01..03: requests (source_id, idempotency_key, enabled, source_type) that no successful job has answered, each
    with what becomes of it."""
    done = jobs.filter("status = 'success'").select("source_id", "idempotency_key").distinct()
    left = requests.dropDuplicates(["source_id", "idempotency_key"]).join(done, ["source_id", "idempotency_key"], "left_anti")
    return left.filter("source_type <> 'uploaded'").withColumn("status", F.when(F.col("enabled"), "queued").otherwise("failed"))


def import_quality(rows: DataFrame) -> DataFrame:
    """AGG-09, WIN-04: counters of an import file with columns row, cin, name, registered, state, capital.

    Repeats are counted from groups' sizes, so no window orders the file."""
    blank = lambda c: F.coalesce(text.strip_all(F.col(c)) == "", F.lit(True))
    cin = text.strip_all(F.coalesce("cin", F.lit("")))
    bad_money = ~blank("capital") & values.clean_number(F.col("capital")).isNull()
    totals = rows.agg(
        F.count("*").alias("rows"),
        F.count_if(cin == "").alias("missing_cin"),
        F.count_if((cin != "") & (F.length(cin) != 21)).alias("malformed_cin"),
        F.count_if(blank("registered")).alias("missing_date"),
        F.count_if(blank("state")).alias("missing_state"),
        F.count_if(bad_money).alias("malformed_money"),
    )
    again = lambda key, name: rows.filter(key != "").groupBy(key.alias("k")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(name))
    name = F.lower(text.strip_all(F.coalesce("name", F.lit(""))))
    each = totals.unionByName(again(cin, "duplicate_cin"), True).unionByName(again(name, "duplicate_name"), True)
    return each.agg(*(F.max(c).alias(c) for c in each.columns))  # three rows, each with counters of its own


def custom_import_stats(rows: DataFrame, kinds: dict[str, str], name: str = "legal_name") -> DataFrame:
    """AGG-11: of a mapped custom file: rows, rows with and without a name, and cells that aren't of their field's type."""
    named = F.coalesce(text.strip_all(F.col(name)) != "", F.lit(False))
    bad = [F.coalesce(~values.matches_type(F.col(c), k), F.lit(False)).cast("int") for c, k in kinds.items() if c in rows.columns and k != "string"]
    cells = F.sum(sum(bad[1:], bad[0])) if bad else F.sum(F.lit(0))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(named).alias("valid"), F.count_if(~named).alias("invalid"), F.coalesce(cells, F.lit(0)).cast("bigint").alias("skipped_cells")
    )


def repeats_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-04: rows whose key stood in an earlier row."""
    seen = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("occurrence", F.row_number().over(seen)).filter("occurrence > 1")


def confidence_histogram(companies: DataFrame) -> DataFrame:
    """AGG-10: five buckets of a fifth; 1.0 is alone in a sixth. Companies without a confidence are in none."""
    companies = companies.filter(F.col("confidence").isNotNull())
    bucket = F.floor(F.col("confidence") * 5).cast("int")
    label = F.concat((bucket * 20).cast("string"), F.lit("-"), (bucket * 20 + 20).cast("string"), F.lit("%"))
    return companies.groupBy(bucket.alias("bucket"), label.alias("label")).agg(F.count("*").alias("companies"))


def countries(sources: DataFrame) -> DataFrame:
    """AGG-13."""
    return sources.select(F.explode("countries").alias("country")).distinct()


def newest_financials(financials: DataFrame) -> DataFrame:
    """WIN-07: each company's latest year."""
    year = Window.partitionBy("company_id").orderBy(F.desc("financial_year"))
    return financials.withColumn("n", F.row_number().over(year)).filter("n = 1").drop("n")


def queue_detail(queue: DataFrame, companies: DataFrame) -> DataFrame:
    """ER-12, JN-08: pending candidates with their company's name, if there still is one."""
    names = companies.select("company_id", F.col("canonical_name").alias("company_name"))
    return queue.filter("status = 'pending'").join(names, "company_id", "left")


def allowed_calls(calls: DataFrame) -> DataFrame:
    """WIN-08, STM-04: calls (source_id, at, limit_per_minute, call_id) with whether each is allowed: fewer than the limit
    were allowed within the sixty seconds before. Turned-down calls don't count, so each source is a fold in order: its
    calls stream by, and only the last minute's allowed ones are held."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, held = None, deque()
        for part in parts:
            out = []
            for s, at, limit in zip(part["source_id"], part["micros"], part["limit_per_minute"], strict=True):
                if s != source:
                    source, held = s, deque()
                while held and held[0] <= at - RATE_WINDOW_SECONDS * 1_000_000:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(at)
            yield pd.DataFrame({"source_id": part["source_id"], "call_id": part["call_id"], "allowed": out})

    kind = dict(calls.dtypes)
    rows = calls.select("source_id", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), "limit_per_minute", "call_id")
    rows = rows.repartition("source_id").sortWithinPartitions("source_id", "micros", "call_id")
    return rows.mapInPandas(fold, f"source_id {kind['source_id']}, call_id {kind['call_id']}, allowed boolean")


def broken_rules(companies: DataFrame, evidence: DataFrame, financials: DataFrame, jobs: DataFrame) -> DataFrame:
    """The uniqueness that tables must keep (cin; company and field; company and year; source and key), as counts of keys
    that break it."""
    rules = (
        ("company cin", companies.filter("cin IS NOT NULL"), ["cin"]),
        ("evidence company, field", evidence, ["company_id", "field"]),
        ("financials company, year", financials, ["company_id", "financial_year"]),
        ("job source, key", jobs.filter("idempotency_key IS NOT NULL"), ["source_id", "idempotency_key"]),
    )
    out = None
    for name, table, key in rules:
        broken = table.groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = broken if out is None else out.union(broken)
    return out


def as_of(day: datetime) -> Column:
    """Wall-clock times are parameters, never now()."""
    return F.lit(day)
