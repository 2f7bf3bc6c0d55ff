"""Evidence: from observations to one scored value per company and field, and canonical companies (CNF, CAN, AGG-01..05).

Grouped aggregates and one window over the groups' few distinct values; the observations are shuffled once, by company and
field, after a partial aggregate by value, so a company with very many equal observations is a few rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text, values

# What labels weigh, and the formula's constants.
WEIGHTS = {"verified": 1.0, "observed": 0.7, "estimated": 0.5, "unknown": 0.1}
DECAY_DAYS, BONUS, LARGEST_BONUS, PENALTY = 365.0, 0.05, 0.15, 0.30
DIRECT = ("legal_name", "website", "public_phone", "public_email", "registered_address", "company_type", "cin", "gstin", "industry", "sub_industry", "company_category")
LISTS = ("products", "services", "operating_locations", "markets_served")
WHOLE = ("employee_count", "employee_range_min", "employee_range_max", "revenue_year")
MONEY = ("annual_revenue_inr", "revenue_range_min_inr", "revenue_range_max_inr")


def label_weight(label: Column, other: float) -> Column:
    out = F.lit(other)
    for name, weight in WEIGHTS.items():
        out = F.when(label == name, weight).otherwise(out)
    return out


def scored(observations: DataFrame, sources: DataFrame, now: datetime) -> DataFrame:
    """CNF-01, CNF-02: each observation's score and the key its value votes under.

    Sources join by id, broadcast where Spark finds them small enough."""
    rows = observations.join(sources.select("source_id", "reliability_weight"), "source_id")
    return rows.withColumns(
        {
            "value_key": F.lower(text.strip_all(F.coalesce("value", F.lit("")))),
            "score": _score(F.col("collected_at"), now),
            "label_weight": label_weight(F.col("verification_type"), 0.0),
        }
    )


def _score(collected_at: Column, now: datetime) -> Column:
    weight = F.greatest(F.lit(0), F.least(F.lit(100), F.col("reliability_weight"))) / 100.0
    age = F.greatest(F.lit(0.0), values.age_days(F.lit(now), collected_at))
    return weight * label_weight(F.col("verification_type"), WEIGHTS["unknown"]) * F.exp(-age / DECAY_DAYS)


def roll_up(scores: DataFrame) -> DataFrame:
    """CNF-03..12: the winning value of each (company, field) with its confidence and what explains it."""
    place = F.struct("collected_at", "obs_id")
    strongest = F.struct((-F.col("label_weight")).alias("w"), F.col("collected_at"), F.col("obs_id"))
    by_value = scores.groupBy("company_id", "field", "value_key").agg(
        F.count("*").alias("agreeing"),
        F.max("score").alias("best"),
        F.min(place).alias("first_seen"),
        F.min_by(F.struct("value", "verification_type"), strongest).alias("strongest"),
        F.max("collected_at").alias("newest"),
    )
    newest = F.max("newest").over(Window.partitionBy("company_id", "field"))
    return _winners(by_value.withColumn("newest", newest)).select(
        "company_id", "field",
        F.col("strongest.value").alias("value"),
        F.col("strongest.verification_type").alias("verification_type"),
        "confidence", "agreeing", "total", "base", "bonus", "penalty", "agreement", "newest",
    )


def _winners(by_value: DataFrame) -> DataFrame:
    """CNF-04..10: the row of the winning value of each (company, field), with its confidence and that one's parts."""
    group = Window.partitionBy("company_id", "field")
    order = group.orderBy(F.desc("agreeing"), F.desc("best"), F.asc("first_seen"))
    ranked = by_value.select("*", F.sum("agreeing").over(group).alias("total"), F.row_number().over(order).alias("rank"))
    ratio = F.col("agreeing") / F.col("total")
    bonus = F.least(F.lit(LARGEST_BONUS), BONUS * (F.col("agreeing") - 1))
    penalty = (1 - ratio) * PENALTY
    return ranked.filter("rank = 1").select(
        "*",
        F.round(values.clamp01(F.col("best") + bonus - penalty), 3).alias("confidence"),
        F.round("best", 3).alias("base"), F.round(bonus, 3).alias("bonus"), F.round(penalty, 3).alias("penalty"), F.round(ratio, 3).alias("agreement"),
    )


def explanations(scores: DataFrame, now: datetime) -> DataFrame:
    """CNF-12: what each confidence rests on: its parts, and how many observations of which weight and label agree. Weights are
    whole numbers up to 100 and labels few, so a group's list is short however many observations agree. No company or no field: no row.

    Observations are read once and shuffled once, by company and field, and all that follows stays in those partitions: few of
    a group's observations have equal value, weight and label, so counts ahead of a shuffle save little, and each further one
    writes about as much again. A group's observations stream through one task, sorted, and aren't held there. Their scores don't
    travel: of one weight and label, the newest has the best one (without a time, an observation is scored as of now)."""
    rows = scores.filter("company_id IS NOT NULL AND field IS NOT NULL").repartition("company_id", "field")
    newest = F.max(F.coalesce("collected_at", F.lit(now)))
    by_voice = rows.groupBy("company_id", "field", "value_key", "reliability_weight", "verification_type").agg(
        F.count("*").alias("n"), _score(newest, now).alias("best"), F.min(F.struct("collected_at", "obs_id")).alias("first_seen")
    )
    each = F.struct("reliability_weight", "verification_type", "n")
    by_value = by_voice.groupBy("company_id", "field", "value_key").agg(
        F.sum("n").alias("agreeing"), F.max("best").alias("best"), F.min("first_seen").alias("first_seen"), F.sort_array(F.collect_list(each)).alias("voices")
    )
    parts = F.struct(
        F.col("base").alias("base_score"), F.col("bonus").alias("independent_source_bonus"), F.col("penalty").alias("conflict_penalty"),
        F.col("agreement").alias("agreement_ratio"), F.col("agreeing").alias("agreeing_observation_count"), F.col("total").alias("total_observation_count"),
        "voices",
    )
    return _winners(by_value).select("company_id", "field", parts.alias("explanation"))


def confidence_of(wanted: DataFrame, rolled: DataFrame) -> DataFrame:
    """CNF-13: the evidence for each wanted (company_id, field); 0.0 and "unknown" where no observation speaks."""
    found = wanted.join(rolled.select("company_id", "field", "value", "confidence", "verification_type"), ["company_id", "field"], "left")
    silent = F.col("confidence").isNull()
    return found.select(
        "company_id", "field", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("verification_type", F.lit("unknown")).alias("verification_type"),
        F.when(silent, "no_observations").alias("reason"),
    )


def company_confidence(evidence: DataFrame, scores: DataFrame) -> DataFrame:
    """AGG-02..05, CNF-14: per company. Confidences are thousandths, whose sum doesn't hang on its order."""
    thousandths = F.sum(F.round(F.col("confidence") * 1000).cast("bigint"))
    mean = F.floor((2 * thousandths + F.count("*")) / (2 * F.count("*"))) / 1000.0
    fields = evidence.groupBy("company_id").agg(
        mean.alias("confidence"),
        F.max(F.when(F.col("verification_type") == "verified", F.col("newest"))).alias("last_verified_at"),
        F.count("*").alias("field_count"),
    )
    # distinct pairs first, so that a company of many observations isn't one task's set
    sources = scores.select("company_id", "source_id").distinct().groupBy("company_id").agg(F.count("*").alias("source_count"))
    return fields.join(sources, "company_id")


def canonical(evidence: DataFrame) -> DataFrame:
    """SNK-04: evidence as one row per company, typed; a field without a value is null. The fields are known, so the
    pivot needs no extra pass."""
    known = [*DIRECT, "canonical_name", "export_status", "state", "city", "country", "country_code", *LISTS, *WHOLE, *MONEY, "incorporation_date"]
    wide = evidence.groupBy("company_id").pivot("field", known).agg(F.first("value"))
    c = F.col
    return wide.select(
        "company_id",
        *(c(n) for n in DIRECT),
        c("canonical_name").alias("normalized_name"),
        values.safe_bool(c("export_status")).alias("export_status"),
        *(text.title_case(text.strip_all(c(n))).alias(n) for n in ("state", "city")),
        text.strip_all(c("country")).alias("country"),
        text.identifier(c("country_code")).alias("country_code"),
        *(text.comma_list(c(n)).alias(n) for n in LISTS),
        *(values.safe_int(c(n)).alias(n) for n in WHOLE),
        *(values.safe_float(c(n)).cast("decimal(20,2)").alias(n) for n in MONEY),
        values.safe_date(c("incorporation_date")).alias("incorporation_date"),
    )


def lineage(scores: DataFrame) -> DataFrame:
    """D8: which observations each piece of evidence rests on."""
    return scores.select("company_id", "field", "obs_id", "source_id")


def detail(companies: DataFrame, evidence: DataFrame) -> DataFrame:
    """PRJ-04: companies with their evidence, by field."""
    each = F.struct("field", "value", "verification_type", "confidence")
    lists = evidence.groupBy("company_id").agg(F.sort_array(F.collect_list(each)).alias("evidence"))
    return companies.join(lists, "company_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(lists.schema["evidence"].dataType)))
