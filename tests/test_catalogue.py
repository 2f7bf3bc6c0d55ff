"""Every query with an oracle agrees with the other engine on the smallest tables."""

import datetime
import decimal
import hashlib
import re

import duckdb
import pytest

from factloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert rows or name.startswith("er_")
        return
    result = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_every_query_is_registered(spark):
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_white_space_of_every_document(spark, tmp_path):
    texts = ["a \t b", None, "", "5 €  “x” – y ", "日本　 語", "😀\n\n😀", "é  é", "   "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in catalogue.queries()["norm_whitespace"](spark, str(tmp_path)).collect()}
    want = [re.sub(r"\s+", " ", x or "").strip() for x in texts]
    assert got == {i: hashlib.md5(x.encode()).hexdigest() for i, x in enumerate(want)}
