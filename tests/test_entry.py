"""The driver contract: every query gives the rows of its SQL on a small folder."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["metric", "total", "g1", "g2", "diff"] and out.count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["group_metrics_at_10", "F9_F13_unfairness", "Q2_F7_mann_whitney", "P4_k_fold", "W3_sessions"])
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in cur.fetchall())
    assert sorted(str([round(r[c], 5) if isinstance(r[c], float) else r[c] for c in names]) for r in df.collect()) == want
