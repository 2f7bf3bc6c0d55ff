import datetime
import os
import random

from pyspark.sql import functions as F

from factloom.plans import catalogue
from factloom.streaming import file_drop, ledger, rate_limits

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def _loop(calls):
    held, out = {}, {}
    for source, at, limit, call in sorted(calls, key=lambda c: (c[0], c[1], c[3])):
        mine = [x for x in held.get(source, []) if x > at - datetime.timedelta(seconds=60)]
        out[call] = len(mine) < limit
        held[source] = mine + [at] * out[call]
    return out


def _run(spark, tmp_path, drops):
    out = str(tmp_path / "out")
    for calls in drops:
        spark.createDataFrame(calls, rate_limits.CALL).write.mode("append").parquet(str(tmp_path / "in"))
        file_drop.run_available(rate_limits.allowed(rate_limits.calls(spark, str(tmp_path / "in"))), str(tmp_path / "state"), ledger.once(out)).awaitTermination()
    return ledger.rows(spark, out, "source_id long, call_id long, allowed boolean").collect()


def test_rate_limits_hold_over_batches(spark, tmp_path):
    pick = random.Random(4)
    times = sorted(START + datetime.timedelta(seconds=pick.randrange(1200)) for _ in range(300))  # many at one time
    calls = [(s := pick.randrange(4), at, 1 + s, i) for i, at in enumerate(times)]
    got = _run(spark, tmp_path, [calls[:90], calls[90:91], calls[91:200], calls[200:]])
    want = _loop(calls)
    assert {r.call_id: r.allowed for r in got} == want and len(got) == 300 and 20 < sum(want.values()) < 280


def test_a_pause_empties_the_state(spark, tmp_path):
    late = START + datetime.timedelta(hours=5)
    drops = [[(1, START, 1, 1), (2, START, 1, 2)], [(2, late, 1, 3)], [(1, late + datetime.timedelta(hours=1), 1, 4), (2, late + datetime.timedelta(hours=1), 0, 5)]]
    assert {r.call_id: r.allowed for r in _run(spark, tmp_path, drops)} == {1: True, 2: True, 3: True, 4: True, 5: False}


def test_a_repeated_batch_writes_nothing_and_a_broken_one_is_written_anew(spark, tmp_path):
    folder = str(tmp_path / "table")
    handle = ledger.once(folder)
    assert ledger.rows(spark, folder, "id long").count() == 0
    handle(spark.range(5), 0)
    before = sorted(os.listdir(f"{folder}/rows/batch=0"))
    handle(spark.range(7), 0)
    assert sorted(os.listdir(f"{folder}/rows/batch=0")) == before
    spark.range(100, 130).write.parquet(f"{folder}/rows/batch=1")  # its number isn't in the ledger
    assert ledger.rows(spark, folder, "id long").count() == 5
    handle(spark.range(100, 103), 1)
    assert sorted(r.id for r in ledger.rows(spark, folder, "id long").collect()) == [0, 1, 2, 3, 4, 100, 101, 102]
    assert sorted(map(tuple, ledger.written(spark, folder).collect())) == [(0, 5), (1, 3)]


def test_limits_are_reached_in_the_registered_replay(spark):
    rows = catalogue.queries()["rate_limited_stream"](spark, "/root/testdata/sf0.001")
    counts = {r.allowed: r["count"] for r in rows.groupBy("allowed").agg(F.count("*").alias("count")).collect()}
    batch = catalogue.queries()["rate_limited_by_source"](spark, "/root/testdata/sf0.001")
    assert counts[True] + counts.get(False, 0) == batch.count() and rows.exceptAll(batch).count() == 0
