"""A batch from observations to companies: resolve, attach, create or queue, then evidence and canonical rows.

The batch is resolved against what is stored, and what is left is resolved against itself, in order of arrival:
a record is a new company unless an earlier new one scores for review or more; then it is attached to the best of
these, or queued. Evidence is rolled up once for all companies that the batch touches.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import evidence, resolution
from factloom.operators.cut import cut

# Which observed field gives which signal.
SIGNAL_FIELDS = {"cin": "cin", "gstin": "gstin", "website": "domain", "canonical_name": "name", "state": "state", "postal_code": "postal", "public_email": "email_domain"}


@dataclass(frozen=True)
class Batch:
    """links: (record_id, company_id); queue: (record_id, company_id, score, signals); dropped: (record_id); stubs and aliases: of
    companies that the batch creates."""

    links: DataFrame
    queue: DataFrame
    dropped: DataFrame
    observations: DataFrame
    evidence: DataFrame
    companies: DataFrame
    stubs: DataFrame
    aliases: DataFrame


def signals(observations: DataFrame, key: str = "record_id") -> DataFrame:
    """ER-01: per record, the last observation of each identifying field. ``public_email`` and ``website`` by their domains."""
    place = F.struct("collected_at", "obs_id")
    wide = observations.groupBy(key).pivot("field", list(SIGNAL_FIELDS)).agg(F.max_by("value", place))
    named = wide.select(key, *(F.col(f).alias(s) for f, s in SIGNAL_FIELDS.items()))
    return named.withColumns({"domain": text.normalize_domain(F.col("domain")), "email_domain": text.email_domain(F.col("email_domain"))})


def among_themselves(records: DataFrame) -> DataFrame:
    """(record_id, into, score, signals): for records in order of their ids, the new record that each goes to; itself, if
    it is new. Only records that share an identifier or trigrams are compared."""
    as_companies = records.withColumnRenamed("record_id", "company_id")
    pairs = resolution.candidates(records, as_companies).filter("company_id < record_id")
    judged = cut(resolution.scored(pairs, records, as_companies).filter(F.col("score") >= resolution.REVIEW), "judged")
    edges = judged.select(F.col("company_id").alias("earlier"), F.col("record_id").alias("later"))
    state = resolution.first_come(edges, records.select(F.col("record_id").alias("id")))
    new = state.filter("state = 'new'").select(F.col("id").alias("company_id"))
    best = Window.partitionBy("record_id").orderBy(F.desc("score"), F.asc("company_id"))
    target = judged.join(new, "company_id", "left_semi").withColumn("n", F.row_number().over(best)).filter("n = 1")
    target = target.select("record_id", F.col("company_id").alias("into"), "score", "signals")
    out = state.select(F.col("id").alias("record_id"), "state").join(target, "record_id", "left")
    return out.select("record_id", F.when(F.col("state") == "new", F.col("record_id")).otherwise(F.col("into")).alias("into"), F.when(F.col("state") != "new", F.col("score")).alias("score"), "signals")


def touched(observations: DataFrame) -> DataFrame:
    """SET-03: the companies (company_id) that observations speak of, each once."""
    return observations.select("company_id").filter("company_id IS NOT NULL").distinct()


def company_id_of(record: str) -> Column:
    """New companies' ids follow from their record, so a repeated run gives the same."""
    return F.sha2(F.concat_ws("|", F.lit("company"), F.col(record).cast("string")), 256)


def ingest(observations: DataFrame, stored_signals: DataFrame, stored_observations: DataFrame, sources: DataFrame, now: datetime) -> Batch:
    """observations: (record_id, source_id, field, value, verification_type, collected_at, obs_id); stored_signals: (company_id and
    the signals); stored_observations: the same as observations, with company_id for record_id."""
    records = cut(resolution.folded(signals(observations), "record_id"), "records")
    companies = resolution.folded(stored_signals, "company_id")
    decided = cut(resolution.outcomes(resolution.resolve(records, companies)), "decided")
    fresh = records.join(decided.filter("outcome = 'create'").select("record_id"), "record_id", "left_semi")
    own = cut(among_themselves(fresh), "own")
    sure = F.col("score").isNull() | (F.col("score") >= resolution.AUTO)
    links = decided.filter("outcome = 'attach'").select("record_id", F.col("company_id").cast("string").alias("company_id"))
    links = links.unionByName(own.filter(sure).select("record_id", company_id_of("into").alias("company_id")))
    queue = decided.filter("outcome = 'queue'").select("record_id", F.col("company_id").cast("string").alias("company_id"), "score", "signals")
    queue = queue.unionByName(own.filter(~sure).select("record_id", company_id_of("into").alias("company_id"), "score", "signals"))
    kept = ["company_id", "source_id", "field", "value", "verification_type", "collected_at", "obs_id"]
    attached = observations.join(links, "record_id").select(*kept)
    before = stored_observations.withColumn("company_id", F.col("company_id").cast("string")).join(touched(links), "company_id", "left_semi").select(*kept)
    scores = cut(evidence.scored(attached.unionByName(before), sources, now), "scores")
    rolled = evidence.roll_up(scores)
    rows = evidence.canonical(rolled).join(evidence.company_confidence(rolled, scores), "company_id")
    created = fresh.join(own.filter("into = record_id").select("record_id"), "record_id", "left_semi")
    return Batch(links, queue, decided.filter("outcome = 'drop'").select("record_id"), attached, rolled, rows, stubs(created), aliases(created))


def stubs(records: DataFrame) -> DataFrame:
    """SNK-03: the first rows of new companies, from their record's signals."""
    c = F.col
    return records.select(
        company_id_of("record_id").alias("company_id"), c("name").alias("canonical_name"), c("name").alias("normalized_name"), "cin", "gstin",
        c("domain").alias("website_domain"), text.title_case(c("state")).alias("state"), c("postal").alias("postal_code"),
        F.lit(0.0).alias("confidence"), F.lit(0).alias("source_count"),
    )


def aliases(records: DataFrame) -> DataFrame:
    """SNK-03: the name under which each new company came."""
    named = records.filter("name IS NOT NULL")
    return named.select(company_id_of("record_id").alias("company_id"), F.col("name").alias("alias"), F.col("name").alias("normalized_alias"))


def confirmed(queue: DataFrame, verdicts: DataFrame, observations: DataFrame) -> DataFrame:
    """ER-10, ER-13: the observations that confirmed reviews attach, by record; evidence is then rolled up again."""
    chosen = queue.join(verdicts.filter("verdict = 'confirm'").select("record_id"), "record_id", "left_semi").select("record_id", "company_id")
    return observations.join(chosen, "record_id")


def siblings(confirmed_candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """JN-10, ER-10: unattached observations with the source and time of a confirmed candidate's own (obs_id, company_id), attached
    to its company. Of candidates that share source and time the first holds."""
    seeds = observations.select("obs_id", "source_id", "collected_at").join(confirmed_candidates.select("obs_id", "company_id"), "obs_id")
    batches = seeds.groupBy("source_id", "collected_at").agg(F.min_by("company_id", "obs_id").alias("company_id"))
    return observations.filter("company_id IS NULL").drop("company_id").join(batches, ["source_id", "collected_at"])
