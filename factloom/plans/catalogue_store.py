"""Registered queries over stored evidence: batches that touch some companies, and facts in buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import evidence
from factloom.operators.cut import scratch
from factloom.plans.bridge import Tables
from factloom.plans.catalogue import _ROLLED, AS_OF, query
from factloom.plans.evidence_store import EvidenceStore, bucketed

_KEPT = "(collected_at < TIMESTAMP '1996-01-01' OR company_id % 9 = 0)"
_SOME = _ROLLED.replace("FROM observations o JOIN", f"FROM (SELECT * FROM observations WHERE {_KEPT}) o JOIN")
_COLUMNS = "company_id, field, value, verification_type, round(raw, 3) AS confidence, agreeing, CAST(total AS BIGINT) AS total"


def _store(t: Tables) -> EvidenceStore:
    """Early observations, then a batch of later ones of some companies."""
    store, rows, sources = EvidenceStore(t.spark, scratch(t.spark, "store"), 16), t.view("observations"), t.view("sources")
    early = F.col("collected_at") < F.lit("1996-01-01").cast("timestamp")
    store.ingest(rows.filter(early), sources, AS_OF)
    store.ingest(rows.filter(~early & (F.col("company_id") % 9 == 0)), sources, AS_OF)
    return store


@query(f"WITH {_SOME} SELECT {_COLUMNS} FROM evidence", "observations", "sources")
def evidence_incremental(t: Tables) -> DataFrame:
    """SNK-02, SNK-04: only what a batch touches is computed again, and all is as if everything were."""
    return _store(t).table("evidence").select("company_id", "field", "value", "verification_type", "confidence", "agreeing", "total")


_WORN = _SOME.replace("s.reliability_weight", "(100 - s.reliability_weight)")


@query(
    f"SELECT company_id, field, confidence FROM (WITH {_SOME} SELECT {_COLUMNS} FROM evidence) WHERE company_id % 10 <> 0 UNION ALL "
    f"SELECT company_id, field, confidence FROM (WITH {_WORN} SELECT {_COLUMNS} FROM evidence) WHERE company_id % 10 = 0",
    "observations", "sources",
)
def evidence_reprocessed(t: Tables) -> DataFrame:
    """ER-13: after sources are weighed anew, a set of companies is reprocessed from what is stored."""
    store, sources = _store(t), t.view("sources")
    ids = t.view("companies").select("company_id").filter("company_id % 10 = 0")
    store.reprocess(ids, sources.withColumn("reliability_weight", 100 - F.col("reliability_weight")), AS_OF)
    return store.table("evidence").select("company_id", "field", "confidence")


@query(
    f"""WITH {_ROLLED} SELECT e.company_id, CAST((2 * sum(CAST(round(raw * 1000) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000 AS confidence, count(*) AS field_count,
    any_value(n.source_count) AS source_count FROM evidence e JOIN (SELECT company_id, count(DISTINCT source_id) AS source_count FROM scored GROUP BY 1) n ON e.company_id = n.company_id GROUP BY e.company_id""",
    "observations", "sources",
)
def bucketed_confidence(t: Tables) -> DataFrame:
    """JN-01, JN-09, AGG-01: company confidence from facts in buckets, without a shuffle of theirs."""
    facts = bucketed(t.view("observations"), f"facts_{uuid.uuid4().hex}", scratch(t.spark, "facts"), 16)
    scores = evidence.scored(facts, t.view("sources"), AS_OF)
    return evidence.company_confidence(evidence.roll_up(scores), scores).select("company_id", "confidence", "field_count", "source_count")
