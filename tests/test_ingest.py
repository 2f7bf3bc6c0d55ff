from datetime import datetime, timedelta

from factloom.plans import ingest as I

NOW = datetime(2024, 1, 1)
OBS = "record_id long, source_id long, field string, value string, verification_type string, collected_at timestamp, obs_id string"
SIGNALS = "company_id string, cin string, gstin string, domain string, name string, state string, postal string, email_domain string"


def _observations(spark, records):
    rows = [(r, 1, f, v, "verified", NOW - timedelta(days=9), f"{r}-{f}") for r, fields in records.items() for f, v in fields.items()]
    return spark.createDataFrame(rows, OBS)


def test_a_batch(spark):
    records = {
        1: {"cin": "C1", "canonical_name": "stored one", "state": "delhi"},  # known by its number
        2: {"cin": "N2", "canonical_name": "brand new works", "employee_count": "40"},  # new
        3: {"cin": "n2 ", "canonical_name": "brand new works"},  # the same number as the new one
        4: {"canonical_name": "brand new works"},  # only the name: for review
        5: {"canonical_name": "stored two", "website": "https://www.two.example/x"},  # domain of a stored one: for review
        6: {"industry": "tea"},  # without a name: dropped
        7: {"canonical_name": "something else entirely", "public_email": "a@mail.example"},
    }
    stored = spark.createDataFrame([("s1", "c1", None, None, "stored one", None, None, None), ("s2", None, None, "two.example", "other", None, None, None)], SIGNALS)
    old = spark.createDataFrame([("s1", 1, "state", "goa", "observed", NOW - timedelta(days=5), "old")], OBS.replace("record_id long", "company_id string"))
    sources = spark.createDataFrame([(1, 90)], "source_id long, reliability_weight int")
    batch = I.ingest(_observations(spark, records), stored, old, sources, NOW)
    links = {r.record_id: r.company_id for r in batch.links.collect()}
    assert set(links) == {1, 2, 3, 7} and links[1] == "s1" and links[2] == links[3] != links[7]
    queue = {r.record_id: r for r in batch.queue.collect()}
    assert set(queue) == {4, 5} and queue[4].company_id == links[2] and queue[5].company_id == "s2" and queue[4].score == 0.55
    assert [r.record_id for r in batch.dropped.collect()] == [6]
    rows = {r.company_id: r for r in batch.companies.collect()}
    assert set(rows) == {"s1", links[2], links[7]} and rows[links[2]].employee_count == 40 and rows[links[2]].source_count == 1
    assert rows["s1"].state == "Goa" or rows["s1"].state == "Delhi"
    state = {r.field: r for r in batch.evidence.filter("company_id = 's1'").collect()}["state"]
    assert state.total == 2 and state.agreeing == 1
    verdicts = spark.createDataFrame([(4, "confirm"), (5, "reject")], "record_id long, verdict string")
    more = I.confirmed(batch.queue, verdicts, _observations(spark, records)).collect()
    assert {(r.record_id, r.company_id) for r in more} == {(4, links[2])}


def test_an_empty_batch(spark):
    stored = spark.createDataFrame([], SIGNALS)
    old = spark.createDataFrame([], OBS.replace("record_id long", "company_id string"))
    sources = spark.createDataFrame([], "source_id long, reliability_weight int")
    batch = I.ingest(spark.createDataFrame([], OBS), stored, old, sources, NOW)
    assert batch.links.count() == batch.queue.count() == batch.companies.count() == 0
