import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't there")


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "freq", "score"] and rows.count() <= 10


def test_queries_match_sql(spark):
    import duckdb

    from sparkdex.plans import catalog

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    sql, found = catalog.oracle_sql(), catalog.queries()
    assert sql.keys() == found.keys()
    for name in found:
        a, b = found[name](spark, SF).toPandas(), con.execute(sql[name]).df()
        columns = sorted(a.columns)
        assert sorted(b.columns) == columns and len(a) == len(b), name
        rows = [x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (a, b)]
        assert rows[0].equals(rows[1]), name
