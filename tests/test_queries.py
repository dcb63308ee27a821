import datetime
import decimal
import os

import duckdb
import pytest

from assetloom import plans
from assetloom.plans import adhoc

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in adhoc.DRIVER_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.sql(plans.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("text", ["DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE TABLE y AS SELECT 1", "SET a=b", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "CACHE TABLE x", "SHOW TABLES", "DELETE FROM x", "UPDATE x SET a = 1", "MERGE INTO x USING y ON x.a = y.a WHEN MATCHED THEN DELETE", "EXECUTE IMMEDIATE 'SELECT 1'", "USE x", "BEGIN SELECT 1; END", "SELECT transform(id) USING 'cat' FROM x", "SELECT (SELECT max(a) FROM (SELECT transform(id) USING 'cat' AS (a) FROM x))", "WITH q AS (SELECT transform(id) USING 'cat' AS (a) FROM x) SELECT * FROM q", "SELECT java_method('java.lang.System', 'getenv', 'HOME')"])
def test_only_queries_are_taken(spark, text):
    spark.range(1).createOrReplaceTempView("x")
    with pytest.raises(ValueError, match="SELECT"):
        adhoc.query(spark, text)


def test_every_registered_query_is_read_only(spark, tmp_path):
    from assetloom.plans.relational import TEXTS

    parser = spark._jsparkSession.sessionState().sqlParser()
    for text in TEXTS.values():
        assert adhoc._reads_only(parser.parsePlan(adhoc.with_glob(text if isinstance(text, str) else text[0])))


def test_glob_is_translated_outside_strings(spark):
    assert adhoc.with_glob("SELECT 'x GLOB ''a'' ', a GLOB 'b*' -- GLOB 'c'") == "SELECT 'x GLOB ''a'' ', a RLIKE '^b(?s:.*)$' -- GLOB 'c'"
    spark.createDataFrame([("it's",), ("a.b",), ("axb",), ("A.B",)], "v string").createOrReplaceTempView("g")
    got = lambda p: [r.v for r in adhoc.query(spark, f"SELECT v FROM g WHERE v GLOB {p} ORDER BY v").collect()]
    assert got("'a.b'") == ["a.b"] and got("'it''s'") == ["it's"] and got("'a?b'") == ["a.b", "axb"] and got("'[^a]*'") == ["A.B", "it's"]


def test_query_lines(spark):
    spark.createDataFrame([(1, None), (2, "${id}")], "a int, b string").createOrReplaceTempView("t")
    assert [r.value for r in adhoc.query_lines(spark, "SELECT *, '${x}' AS c FROM t ORDER BY a").collect()] == ['{"a":1,"b":null,"c":"${x}"}', '{"a":2,"b":"${id}","c":"${x}"}']
    assert adhoc.query(spark, "VALUES (1), (2)").count() == 2 and adhoc.query(spark, "WITH q AS (SELECT 1) SELECT * FROM q").count() == 1
