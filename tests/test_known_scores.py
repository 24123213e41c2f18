"""Scores of train and test rows, for which rows are dealt by item once."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.catalog import ORACLE_SQL, QUERIES
from evenkeel.plans import fairness as P
from evenkeel.sources.views import Views


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a user that isn't listed, one that is listed twice, in both groups, and one of unknown group."""
    path, draw = tmp_path_factory.mktemp("tables"), random.Random(4)
    lines = [(n, draw.randint(1, 40), draw.randint(1, 30), float(draw.randint(1, 50))) for n in range(900)]
    spark.createDataFrame([(n, u) for n, u, _, _ in lines], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.timestamp_seconds(F.col("o_orderkey") * 7919 % 1009)).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(n, i, q) for n, _, i, q in lines], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([*((u, u % 3) for u in range(1, 40)), (7, 0), (41, 1)], "c_custkey long, c_nationkey int").withColumn("c_nationkey", F.expr("if(c_custkey = 9, null, c_nationkey)")).write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(i, "a", "b") for i in range(1, 31)], "p_partkey long, p_type string, p_brand string").write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["G1_value_adjustment", "G2_parity_adjustment"])
def test_adjustments_are_those_of_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want, got = sorted(con.execute(ORACLE_SQL[name]).fetchall()), sorted(map(tuple, QUERIES[name](spark, folder).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 100
    # Sums of either side put ties of rounding on either side.
    assert all(abs(a - b) < 1.1e-4 for x, y in zip(got, want) for a, b in zip(x[2:], y[2:]))


def test_rows_are_dealt_by_item_once(spark, folder):
    plan = QUERIES["G1_value_adjustment"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "HashJoin" not in plan
    v = Views(spark, folder)
    assert v.known_scores.where("part = 'test'").select("user_id", "item_id", "score").distinct().count() == v.test_scores.where("user_id < 40").count()


def test_items_of_one_group_are_not_adjusted(spark):
    rows = [(1, "train", True, 4.0), (1, "train", False, 1.0), (1, "test", True, 3.0), (1, "test", False, 3.0), (2, "train", True, 5.0), (2, "test", True, 3.0), (2, "test", False, 3.0), (3, "train", True, 5.0), (3, "train", False, 5.0), (3, "test", False, 3.0)]
    table = spark.createDataFrame(rows, "item_id long, part string, sensitive boolean, rating double").withColumn("score", F.lit(3.0))
    got = P.adjusted_scores(table, F.col("part") == "train", 0.5).select("item_id", "sensitive", "adjusted").collect()
    assert sorted(map(tuple, got)) == [(1, False, 2.0), (1, True, 3.5), (2, False, 3.0), (2, True, 3.0), (3, False, 3.0)]
