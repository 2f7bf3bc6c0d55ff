import datetime
import os

from pyspark.sql import functions as F

from factloom.operators import evidence as E
from factloom.plans.evidence_store import EvidenceStore, bucketed

NOW = datetime.datetime(2024, 6, 1)
OBSERVATION = "company_id long, source_id long, field string, value string, verification_type string, collected_at timestamp, obs_id string"
COLUMNS = ["company_id", "field", "value", "confidence", "agreeing", "total"]


def _rows(companies, start=0):
    return [
        (c, (c + i) % 3, f"f{i % 2}", f"v{(c * i) % 3}", ("verified", "observed", "rumour")[i % 3], NOW - datetime.timedelta(days=7 * i + c), f"o{start}-{c}-{i}")
        for c in companies for i in range(8)
    ]


def _sources(spark):
    return spark.createDataFrame([(0, 90), (1, 50), (2, 120)], "source_id long, reliability_weight int")


def _whole(spark, rows):
    scores = E.scored(spark.createDataFrame(rows, OBSERVATION), _sources(spark), NOW)
    rolled = E.roll_up(scores)
    return sorted(map(tuple, rolled.select(*COLUMNS).collect())), sorted(map(tuple, E.company_confidence(rolled, scores).collect()))


def _stored(store):
    return sorted(map(tuple, store.table("evidence").select(*COLUMNS).collect())), sorted(map(tuple, store.table("companies").select("company_id", "confidence", "last_verified_at", "field_count", "source_count").collect()))


def _files(folder):
    return {os.path.join(d, f) for name in ("evidence", "companies") for d, _, files in os.walk(f"{folder}/{name}") for f in files if f.endswith(".parquet")}


def test_batches_give_what_all_at_once_does_and_leave_other_files(spark, tmp_path):
    store = EvidenceStore(spark, str(tmp_path), 8)
    first = _rows(range(30))
    store.ingest(spark.createDataFrame(first, OBSERVATION), _sources(spark), NOW)
    assert _stored(store) == _whole(spark, first)
    before = _files(tmp_path)
    more = _rows([3, 100], 1)
    store.ingest(spark.createDataFrame(more, OBSERVATION), _sources(spark), NOW)
    assert _stored(store) == _whole(spark, first + more)
    touched = {r.p for r in spark.createDataFrame([(3,), (100,)], "c long").select(F.pmod(F.xxhash64("c"), F.lit(8)).cast("int").alias("p")).collect()}
    kept = {f for f in before if not any(f"part={p}/" in f for p in touched)}
    assert kept and kept <= _files(tmp_path) and len(_files(tmp_path) - kept) <= 2 * len(touched)


def test_reprocessing_a_set_of_ids(spark, tmp_path):
    store = EvidenceStore(spark, str(tmp_path), 4)
    rows = _rows(range(12))
    store.ingest(spark.createDataFrame(rows, OBSERVATION), _sources(spark), NOW)
    before = _stored(store)[0]
    ids = spark.createDataFrame([(1,), (5,), (5,), (None,), (99,)], "company_id long")
    store.reprocess(ids, _sources(spark).withColumn("reliability_weight", F.lit(1)), NOW)
    changed = {r[0] for r, s in zip(_stored(store)[0], before, strict=True) if r != s}
    assert changed == {1, 5}
    store.reprocess(ids, _sources(spark), NOW)
    assert _stored(store)[0] == before


def test_companies_without_observations_lose_their_rows(spark, tmp_path):
    store = EvidenceStore(spark, str(tmp_path), 4)
    store.ingest(spark.createDataFrame(_rows([1]), OBSERVATION), _sources(spark), NOW)
    store.reprocess(spark.createDataFrame([(1,)], "company_id long"), _sources(spark).filter("source_id > 5"), NOW)
    assert _stored(store) == ([], [])
    store.reprocess(spark.createDataFrame([(1,)], "company_id long"), _sources(spark), NOW)
    assert _stored(store) == _whole(spark, _rows([1]))


def test_buckets_spare_the_shuffle(spark, tmp_path):
    rows = _rows(range(20))
    facts = bucketed(spark.createDataFrame(rows, OBSERVATION), "facts_of_test", str(tmp_path / "facts"), 4)
    _sources(spark).write.parquet(str(tmp_path / "sources"))  # a file, whose size Spark knows
    scores = E.scored(facts, spark.read.parquet(str(tmp_path / "sources")), NOW)
    rolled = E.roll_up(scores)
    both = E.company_confidence(rolled, scores)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SelectedBucketsCount" in plan
    assert sorted(map(tuple, both.collect())) == _whole(spark, rows)[1]
    spark.sql("DROP TABLE facts_of_test")
