"""Splits, sampling, readers, sinks and sessions on small tables."""

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import prepare, reshape, sampling, split
from evenkeel.plans import models
from evenkeel.sources import readers, sinks
from evenkeel.streaming import sessions


@pytest.fixture(scope="module")
def log(spark):
    rows = [(u, i, float(1 + (u + i) % 5), 1000 * (i // 2)) for u in range(6) for i in range(u * 4)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long")


def test_user_split_sizes(log):
    out = split.per_user_timestamp_split(log, "user_id", ["ts", "item_id"], 0.1, 0.2)
    sizes = {(r["user_id"], r["part"]): r["count"] for r in out.groupBy("user_id", "part").count().collect()}
    for u in range(1, 6):
        n = 4 * u
        assert sizes.get((u, "test"), 0) == int(n * 0.2) and sizes.get((u, "val"), 0) == int(n * 0.1)
    assert split.per_user_timestamp_split(log, "user_id", ["ts", "item_id"], 0.1, 0.0).where("part = 'test'").count() == 0


def test_part_sizes_and_folds(log):
    assert split.part_sizes(10, [0.7, 0.1, 0.2]) == [7, 1, 2] and sum(split.part_sizes(11, [1 / 3] * 3)) == 11
    n = log.count()
    folds = split.k_fold(log, ["user_id", "item_id"], 7, n)
    assert {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()} == {**{i: n // 7 for i in range(7)}, **({None: n % 7} if n % 7 else {})}
    assert sorted(r["position"] for r in split.positions(log, ["user_id", "item_id"]).collect()) == list(range(n))


def test_sampling_invariants(log):
    items = log.select("item_id").distinct()
    train = log.where("item_id % 3 = 0")
    t = sampling.triplets(train, items, 2)
    assert sampling.violations(t, train, "positive_id", "negative_id").first() == (0, 0)
    assert sorted(map(str, t.collect())) == sorted(map(str, sampling.triplets(train, items, 2).collect()))
    b = sampling.binary_samples(train, items, 1)
    assert b.where("label = 1").count() == train.count()


def test_each_positive_has_its_negatives(spark):
    """Users who know all items, all but one or two, half and few: none of their positives falls short."""
    n_known = {0: 20, 1: 19, 2: 18, 3: 10, 4: 1}
    known = spark.createDataFrame([(u, (i * 7 + u) % 20) for u, n in n_known.items() for i in range(n)], "user_id long, item_id long")
    items = spark.createDataFrame([(i,) for i in range(20)], "item_id long")
    met = {tuple(r) for r in known.collect()}
    got = [tuple(r) for r in sampling.negatives(known, items, known, 3).collect()]
    assert len(got) == len(set(got)) and not {(u, n) for u, _, n in got} & met
    for u, i in met:
        assert len([r for r in got if r[:2] == (u, i)]) == min(3, 20 - n_known[u]), (u, i)


def test_power_transform_round_trip_of_known_values(spark):
    rows = spark.createDataFrame([(0.0,), (3.0,), (-2.0,)], "x double")
    got = [r[0] for r in rows.select(prepare.power_transform(F.col("x"), 1.0)).collect()]
    assert got == pytest.approx([0.0, 3.0, -2.0])
    import math

    skewed = spark.createDataFrame([(math.exp(i / 10) - 1,) for i in range(40)], "x double")
    assert abs(prepare.fit_power(skewed, "x", steps=5)) < 0.1


def test_logic_sentences(spark):
    rows = spark.createDataFrame([("1^~2v3", [True, True, False]), ("1^~2v3", [True, False, False]), ("~1", [False, False, False])], "s string, t array<boolean>")
    got = rows.select(prepare.parse_dnf(F.col("s")).alias("c"), prepare.dnf_holds(prepare.parse_dnf(F.col("s")), F.col("t")).alias("h")).collect()
    assert [r["c"] for r in got] == [[[1, -2], [3]], [[1, -2], [3]], [[-1]]] and [r["h"] for r in got] == [False, True, True]


def test_balanced_sizes():
    assert prepare.balanced_sizes(100, 50, 1, 1) == (50, 50) and prepare.balanced_sizes(90, 50, 2, 1) == (90, 45)


def test_readers(spark, tmp_path):
    (tmp_path / "ratings.dat").write_text("1::10::5::978300760\n2::11::3::978302109\n")
    (tmp_path / "movies.dat").write_text("10::Old Film (1995)::Drama|War\n11::New::Comedy\n")
    (tmp_path / "users.dat").write_text("1::F::1::10::48067\n")
    rows = {r["movie_id"]: r for r in readers.read_movielens(spark, str(tmp_path)).collect()}
    assert rows["10"]["year"] == 1995 and rows["10"]["movie_genres"] == ["Drama", "War"] and rows["11"]["year"] is None
    assert readers.read_movielens_users(spark, str(tmp_path)).first()["age"] == 1
    (tmp_path / "events.tsv").write_text("# user item score\n1\t2\t3.5\n4\t5\t1\n")
    assert [tuple(r) for r in readers.read_events(spark, str(tmp_path / "events.tsv")).collect()] == [(1, 2, 3.5), (4, 5, 1.0)]
    (tmp_path / "reviews.json").write_text('{"reviewerID":"a","asin":"x","overall":4,"unixReviewTime":2}\n{"reviewerID":"a","asin":"x","overall":1,"unixReviewTime":1}\n')
    assert readers.read_reviews(spark, str(tmp_path / "reviews.json")).first()["label"] == 0
    (tmp_path / "plays.tsv").write_text("u1\tt\ta1\tName\tx\ty\nu1\tt\ta1\tName\tx\ty\nu1\tt\t\tNone\tx\ty\n")
    assert [(r["artist_id"], r["plays"]) for r in readers.read_plays_1k(spark, str(tmp_path / "plays.tsv")).collect()] == [("a1", 2)]
    (tmp_path / "people.tsv").write_text("u1\tf\t\tNorway\t\n")
    assert tuple(readers.read_listeners(spark, str(tmp_path / "people.tsv")).first()) == ("u1", "F", -1, "Norway", "NA")


def test_prediction_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("user,7,8\n1,0.5,\n2,,1.5\n")
    assert sorted(map(tuple, readers.read_predictions(spark, str(tmp_path / "wide.csv"), "wide").collect())) == [(1, 7, 0.5), (2, 8, 1.5)]
    (tmp_path / "rank.tsv").write_text("uid\tiid\tscore\tlabel\tq\n1\t2\t0.5\t1\t0\n1\t3\t0.5\t0\t1\n")
    assert sorted(map(tuple, readers.read_predictions(spark, str(tmp_path / "rank.tsv"), "rank").collect())) == [(1, 2, 0.0), (1, 3, 0.5)]
    (tmp_path / "p.json").write_text('{"event": [[1, 2], [3, 4]], "predicted": [0.5, 0.75]}\n')
    assert sorted(map(tuple, readers.read_predictions(spark, str(tmp_path / "p.json"), "json").collect())) == [(1, 2, 0.5), (3, 4, 0.75)]
    with pytest.raises(ValueError):
        readers.read_predictions(spark, "x", "other")


def test_sinks(spark, log, tmp_path):
    folder = str(tmp_path / "splits")
    sinks.write_split(log, folder, "train")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_split(log, folder, "train")
    sinks.write_split(log.limit(1), folder, "train", overwrite=True)
    assert spark.read.parquet(f"{folder}/train").count() == 1
    sinks.write_train_test(log, log, folder)
    assert spark.read.parquet(f"{folder}/train").count() == 1
    users = spark.createDataFrame([(u, u % 2 == 0) for u in range(6)], "user_id long, sensitive boolean")
    sinks.export(list(sinks.EXPORTS), log, log, users, str(tmp_path / "exports"))
    assert spark.read.parquet(str(tmp_path / "exports" / "gendered")).count() == log.count()


def test_overlay_and_completion(spark):
    base = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "user_id int, item_id int, score double")
    update = spark.createDataFrame([(1, 1, 9.0), (1, 2, None)], "user_id int, item_id int, score double")
    assert sorted(r["score"] for r in reshape.overlay(base, update, ["user_id", "item_id"], "score").collect()) == [3.0, 9.0]


def test_least_squares_step_solves_the_normal_equations(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    fixed = [(i, rng.normal(size=2).tolist()) for i in range(8)]
    ratings = [(u, i, float(rng.integers(1, 6))) for u in range(3) for i in range(8)]
    out = models.als_step(spark.createDataFrame(ratings, "user_id int, item_id int, rating double"), spark.createDataFrame(fixed, "item_id int, vector array<double>"), "user_id", "item_id", 2, 0.1)
    q = np.array([v for _, v in fixed])
    for r in out.collect():
        y = np.array([x for u, _, x in ratings if u == r["user_id"]])
        assert r["vector"] == pytest.approx(np.linalg.solve(q.T @ q + 0.1 * np.eye(2), q.T @ y).tolist())


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 01:00:00"), (3, 1, "2024-01-01 01:59:59"), (4, 2, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "event_id int, user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = sorted((r["user_id"], str(r["started"]), r["n_events"]) for r in sessions.session_sizes(events).collect())
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sessions.streamed_sessions(stream).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["user_id"], str(r["started"]), r["n_events"]) for r in spark.table("streamed").collect()) == batch


def test_numbering_equals_a_global_window(spark):
    from evenkeel.operators.numbering import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(5)
    got = numbered(rows, [F.desc("g"), F.col("k")], "i", start=1).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(1, 1001))
    assert [(r["g"], r["k"]) for r in got] == sorted(((r["g"], r["k"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert numbered(rows.limit(0), ["k"], "i").count() == 0
