import pytest
from pyspark.sql import functions as F

from evenkeel.operators import prepare as T
from evenkeel.operators import sampling as N
from evenkeel.operators import split as P
from evenkeel.operators.numbering import running
from evenkeel.plans import fairness as X
from evenkeel.plans import models as G
from evenkeel.plans import statistics as S
from evenkeel.sources import datasets as D
from evenkeel.sources import readers
from evenkeel.sources.views import Views


def test_writer_modes(spark):
    folder = D.scratch(spark, "modes")
    rows = spark.range(5).toDF("id")
    assert D.splits_of(spark, folder) == []
    D.write_dataset(rows, folder, "train")
    D.write_dataset(rows, folder, "test")
    with pytest.raises(Exception, match="already exists"):
        D.write_dataset(rows, folder, "train")
    D.write_dataset(rows.where("id < 2"), folder, "train", True)
    assert D.load_dataset(spark, folder, "train").count() == 2 and D.splits_of(spark, folder) == ["test", "train"]
    D.write_dataset(rows, folder, "val", "all")
    assert D.splits_of(spark, folder) == ["val"] and D.load_dataset(spark, folder, size=3).count() == 3
    with pytest.raises(FileNotFoundError):
        D.load_dataset(spark, folder, "train")
    with pytest.raises(ValueError):
        D.write_dataset(rows, folder, "x", "some")


def test_configurations_have_readable_schemas(spark):
    for config in D.CONFIGS.values():
        assert all(spark.createDataFrame([], schema).columns for schema in config.parts.values())


def test_split_arguments(spark):
    rows = spark.range(103).selectExpr("id % 7 AS user_id", "id AS item_id", "id AS ts")

    def sizes(split, kind):
        return {r["part"]: r["count"] for r in P.train_test(rows, split, kind).groupBy("part").count().collect()}

    assert sizes([80, 20, 3], "random") == {"train": 80, "val": 20, "test": 3}
    assert sizes([None, 20], "random") == {"train": 83, "test": 20}
    assert sizes(["80%", "20%"], "random") == {"train": 82, "test": 21}
    assert sum(sizes([0.7, 0.1, 0.2], "per_user_random").values()) == 103
    assert P.train_test(rows, [0.8, 0.2], "k_fold", folds=5).where("fold IS NOT NULL").groupBy("fold").count().select("count").distinct().collect()[0][0] == 20
    for split, kind in (([None, None], "random"), (["80", "20"], "random"), ([80, 20], "per_user_timestamp"), ([0.8, 20], "random"), ([0.8, 0.2], "other")):
        with pytest.raises(ValueError):
            P.train_test(rows, split, kind)


def test_running_sums_are_made_in_ranges(spark):
    rows = spark.range(1000).selectExpr("CAST(id * 37 % 1000 AS DOUBLE) / 7 AS x", "id AS c")
    out = running(rows, "x", {"upto": "c"}, ranges=9)
    got = [tuple(r) for r in out.select("x", "c", "upto", "next").orderBy("x").collect()]
    total = 0
    for (x, c, upto, ahead), after in zip(got, [g[0] for g in got[1:]] + [None]):
        total += c
        assert upto == total and ahead == after
    assert running(rows.limit(0), "x", {"upto": "c"}).count() == 0
    flags = rows.withColumn("g", F.col("c") % 2 == 0)
    for made in (S.ks_statistic(flags, "x", "g"), S.mann_whitney(flags, "x", "g"), S.cdf_area(flags, "x", "g"), S.kruskal_wallis(flags, "x", "g"), S.gini(rows, "x")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(_range" in plan and "windowspecdefinition(x#" not in plan


def test_candidates_are_those_of_the_rule(spark):
    users, items = spark.range(1, 90).toDF("user_id"), spark.range(1, 3000, 7).toDF("item_id")
    want = {(u, i) for u in range(1, 90) for i in range(1, 3000, 7) if (u * 7919 + i * 104729) % 1000003 % 20 == 0}
    views = Views(spark, "")
    try:
        for partitions in ("4", "100"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = [tuple(r) for r in views.candidates(users, items).collect()]
            assert len(got) == len(want) and set(got) == want
            assert "Cartesian" not in views.candidates(users, items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("block", [3, 1000])
def test_profile_pairs(spark, block):
    rows = spark.createDataFrame([(u, i) for u in range(3) for i in range(0, 10 + 10 * u, u + 1)], "u long, i long")
    want = sorted((u, a, b) for u in range(3) for a in range(0, 10 + 10 * u, u + 1) for b in range(a + u + 1, 10 + 10 * u, u + 1))
    assert sorted(map(tuple, T.profile_pairs(rows, "u", "i", block=block).select("u", "i1", "i2").collect())) == want


def test_dot_products_in_blocks(spark):
    items = spark.range(40).selectExpr("id AS item_id", "array(CAST(id % 7 AS DOUBLE), CAST(id % 3 AS DOUBLE)) AS v")
    queries = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.0, 1.0])], "query_id long, q array<double>")
    want = []
    for q, (a, b) in ((1, (1.0, 0.5)), (2, (0.0, 1.0))):
        best = sorted((-(a * (i % 7) + b * (i % 3)), i) for i in range(40))[:6]
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(best)]
    for blocks in (1, 5):
        got = G.dot_product_top_k(queries, items, 6, query_blocks=2, item_blocks=blocks).select("query_id", "item_id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_complements_without_a_product(spark):
    users, items = spark.range(6).toDF("user_id"), spark.range(20).toDF("item_id")
    known = spark.createDataFrame([(u, i) for u in range(5) for i in range(0, 20, u + 1)], "user_id long, item_id long")
    want = T.complement_pairs(users, items, known).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("item_id").alias("id_sum"))
    assert sorted(map(tuple, T.complement_sums(users, items, known).collect())) == sorted(map(tuple, want.collect()))


def test_dense_users_get_all_negatives(spark):
    positives = spark.createDataFrame([(u, i) for u in range(12) for i in range(100) if i % 12 < u], "user_id long, item_id long")
    items = spark.range(100).toDF("item_id")
    got = N.negatives(positives, items, positives, 5).groupBy("user_id", "item_id").agg(F.countDistinct("negative_id").alias("n"))
    free = {u: 100 - sum(i % 12 < u for i in range(100)) for u in range(12)}
    rows = got.collect()
    assert len(rows) == positives.count() and all(r["n"] == min(5, free[r["user_id"]]) for r in rows)


def test_reranking_goes_on_until_the_groups_are_close(spark):
    """Users of one group begin with three hits each, the others with one: two swaps a user are due."""
    rows = [(u, i, 10.0 - i, u % 2 == 0, int(i < (3 if u % 2 == 0 else 1))) for u in range(8) for i in range(10)]
    out = X.fair_rerank(spark.createDataFrame(rows, "user_id long, item_id long, score double, sensitive boolean, label int"), 4, 0.1)
    got = out.groupBy("user_id", "sensitive").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()
    assert all(r["n"] == 4 for r in got)
    means = [sum(r["hits"] for r in got if r["sensitive"] == g) / 4 for g in (True, False)]
    assert abs(means[0] - means[1]) <= 0.1


def test_synthetic_ratings_and_ratio(spark):
    shares = {("W", "a"): (0.9, 0.8), ("W", "b"): (0.1, 0.2), ("M", "a"): (0.1, 0.2), ("M", "b"): (0.9, 0.8)}
    rows = T.synthetic_ratings(spark, 40, 60, shares)
    assert sorted(map(str, rows.collect())) == sorted(map(str, T.synthetic_ratings(spark, 40, 60, shares).collect()))
    got = {(r["user_type"], r["item_type"]): (r["n"], r["liked"]) for r in rows.groupBy("user_type", "item_type").agg(F.count("*").alias("n"), F.avg((F.col("rating") == 2).cast("int")).alias("liked")).collect()}
    assert all(abs(n / 600 - shares[k][0]) < 0.1 and abs(liked - shares[k][1]) < 0.2 for k, (n, liked) in got.items())
    users = rows.select("user", "gender").distinct()
    kept = T.balance_groups_by_ratio(rows, users, "user", "gender", {"M": 1.0, "F": 2.0}).select("user", "gender").distinct().groupBy("gender").count().collect()
    assert {r["gender"]: r["count"] for r in kept} == {"M": 10, "F": 20}


def test_features_and_names(spark, tmp_path):
    (tmp_path / "users").write_text("# eid age gender occupation zip\n1\t30\tF\tnone\t0\n2\t\tM\tnone\t1\n")
    (tmp_path / "items").write_text("7\tA name\t1999\t0 1 1\n# end\n")
    users, items = readers.read_features(spark, str(tmp_path / "users"), readers.USER_FEATURES), readers.read_features(spark, str(tmp_path / "items"), readers.ITEM_FEATURES)
    events = spark.createDataFrame([(1, 7, 4.0), (2, 8, 1.0), (3, 7, 2.0)], readers.SCORED)
    got = {(r["user"], r["item"]): r for r in readers.with_features(events, users, items).collect()}
    assert got[1, 7]["user_feature"]["age"] == 30 and got[1, 7]["item_feature"]["genres"] == [0, 1, 1]
    assert got[2, 8]["user_feature"]["age"] is None and got[2, 8]["item_feature"] is None and got[3, 7]["user_feature"] is None
    (tmp_path / "ratings.dat").write_text("1::7::4.5::88\n")
    rows = readers.read_named(spark, "movielens", "ratings", str(tmp_path))
    assert rows.schema.simpleString() == "struct<user_id:string,movie_id:string,user_rating:float,timestamp:bigint>" and tuple(rows.first()) == ("1", "7", 4.5, 88)
    with pytest.raises(ValueError):
        readers.read_named(spark, "movielens", "plays", str(tmp_path))
