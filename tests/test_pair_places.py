"""Counts by value and by place, and sums by user, without pairs; the queries that stand on them."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.catalog import ORACLE_SQL, QUERIES
from evenkeel.plans import pair_places, pair_sums, statistics
from evenkeel.sources.views import Views
from test_shortlist import _folder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with many equal scores, a user without any and an item that nobody has."""
    path, draw = tmp_path_factory.mktemp("tables"), random.Random(8)
    lines = [(n, draw.randint(1, 40), draw.randint(1, 400), float(10 * draw.choice((1, 2, 5)))) for n in range(2500)]
    spark.createDataFrame([(n, u) for n, u, _, _ in lines], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.timestamp_seconds(F.col("o_orderkey") * 7919 % 1009)).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(n, i, q) for n, _, i, q in lines], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(u, u % 5) for u in range(1, 42)], "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(i, "a", "b") for i in range(1, 402)], "p_partkey long, p_type string, p_brand string").write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("part, step", [(40_000, 256), (9, 4)])
def test_score_counts_are_those_of_all_pairs(spark, tmp_path, monkeypatch, part, step):
    v = _folder(spark, tmp_path, 80, 900, 30, (1, 2, 3, 4, 5))
    monkeypatch.setattr(pair_places, "_STEP", step)
    monkeypatch.setattr(pair_places, "_CELLS", 500)
    group = (F.col("user_id") % 3).cast("int")
    found = pair_places.score_counts(*v._biases(), group, 1000003, 20, part)
    true = v.predictions.groupBy(F.col("score").alias("x"), group.alias("grp")).agg(F.count("*").alias("n"))
    rows = sorted(map(tuple, true.collect()))
    assert len(rows) > 500 and sorted(map(tuple, found.collect())) == rows


@pytest.mark.parametrize("part", [40_000, 9])
def test_place_counts_are_those_of_all_pairs(spark, tmp_path, part):
    v = _folder(spark, tmp_path, 40, 900, 20, (1, 5))
    cells = v.predictions
    asked = cells.where("item_id % 3 = 0").union(cells.select("user_id", "item_id", F.lit(3.5)).where("item_id % 50 = 1")).select("user_id", "item_id", pair_places.micro(F.col("score")).alias("x"), F.lit(True).alias("by_id"))
    found = pair_places.place_counts(*v._biases(), asked, 1000003, 20, part)
    of = {}
    for r in cells.collect():
        of.setdefault(r["user_id"], []).append((round(r["score"] * 1e6), r["item_id"]))
    want = [(u, i, x, *(sum(map(fits, of[u])) for fits in (lambda s: s[0] > x, lambda s: s[0] == x, lambda s: s[0] == x and s[1] < i, lambda s: s[1] < i))) for u, i, x, _ in map(tuple, asked.collect())]
    assert len(want) > 400 and sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("tests", [True, False])
def test_user_sums_are_those_of_all_pairs(spark, tmp_path, monkeypatch, tests):
    v = _folder(spark, tmp_path, 60, 900, 30, (1, 2, 3, 4, 5))
    monkeypatch.setattr(pair_sums, "_CELLS", 50)
    found = {r["user_id"]: r for r in pair_sums.user_sums(*v._biases(), 1000003, 20, tests, True, 7).collect()}
    x = F.round(F.col("score") * 1e6).cast("long")
    rows = v.scored().where(F.lit(tests) | (F.col("hit") == 0)).withColumn("top", F.expr("max(score) OVER (PARTITION BY user_id)"))
    e = F.exp(F.col("score") - F.col("top"))
    for r in rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(x - 3000000).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(e).alias("weight"), F.sum(e * F.col("score")).alias("weighted")).collect():
        mine = found.pop(r["user_id"])
        assert [mine[c] for c in ("n", "total", "low", "high")] == [r[c] for c in ("n", "total", "low", "high")]
        assert (mine["weight"], mine["weighted"]) == pytest.approx((r["weight"], r["weighted"]))
    assert not found


@pytest.mark.parametrize("name", ["M12_ndcg_tie_averaged", "S31_completed_item_means", "S31_completed_top_k", "G32_ranking_loss", "S31_completed_ranks", "G7_normal_information", "Q2_F7_mann_whitney", "Q1_F6_ks", "Q3_cdf_area", "Q4_chi_square", "Q6_gaussian_information", "Q7_kruskal_wallis", "X4_overlay", "S31_completed_scores"])
def test_queries_make_no_pairs(spark, folder, monkeypatch, name):
    def made(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(Views, "scored", made)
    con = duckdb.connect()
    for table in ("orders", "lineitem", "customer", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, folder)
    cursor = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want, got = sorted(cursor.fetchall(), key=str), sorted((tuple(r[c] for c in names) for r in found.collect()), key=str)
    assert len(got) == len(want)
    assert all(a == (pytest.approx(b, abs=1.1e-5) if isinstance(b, float) else b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_statistics_of_counts_don_t_overflow(spark):
    n = 3 * 10**10
    counts = spark.createDataFrame([(1.0, n, n // 2), (2.0, n, 2 * n)], "x double, c1 long, c2 long")
    u = statistics.mann_whitney_of_counts(counts).first()
    assert u["u1"] + u["u2"] == pytest.approx(5.0 * n * n)
    cells = spark.createDataFrame([(a, b, n * (1 + a * b)) for a in (0, 1, 2) for b in (0, 1)], "a int, b int, o long")
    assert statistics.chi_square_of_counts(cells).first()["dof"] == 2


def test_equalised_scores_make_pairs_once(spark, folder):
    plan = QUERIES["G4_equalised_scores"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("NOT array_contains(seen") == 1
