import random

import pytest

from evenkeel.plans import completion as C


def whole(users, items, scores):
    """The full matrix as documented, by loops."""
    users, items = sorted(set(users)), sorted(set(items))
    n = len(items)
    own = {(u, i): s for u, i, s in scores if u in users and i in items and s is not None}
    low, high = min(own.values(), default=0.0), max(own.values(), default=1.0)
    out, fills = {}, {}
    for u in users:
        mine = [s for (v, _), s in own.items() if v == u]
        fills[u] = round(sum(mine) / len(mine) + 1e-9, 6) if mine else None
        for number, i in enumerate(items):
            step = (number * C.ITEM_FACTOR % n + u * C.USER_FACTOR % n) % n
            out[u, i] = own.get((u, i), fills[u] if mine else low + (high - low) * step / n)
    return out, fills


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(6)
    users, items = list(range(1, 26)), [7 * i for i in range(1, 19)]
    # Users over 20 have no scores; user 3 scores everything, user 4 always the same, so that defaults tie with cells.
    scores = [(u, i, rng.randint(1, 8) / 2) for u in users for i in items if u <= 20 and (u == 3 or rng.random() < 0.4)]
    scores = [(u, i, 2.5 if u == 4 else s) for u, i, s in scores] + [(99, 7, 5.0), (1, 5, 9.0)]
    frames = (
        spark.createDataFrame([(u, "x") for u in users + [None, 1]], "user_id long, extra string"),
        spark.createDataFrame([(i,) for i in items + [None, 7]], "item_id long"),
        spark.createDataFrame(scores + [(None, 7, 1.0), (25, 7, None)], "user_id long, item_id long, score double").repartition(5),
    )
    return users, items, C.complete(*frames), *whole(users, items, scores)


def test_scores_of_pairs(spark, case):
    users, items, matrix, want, _ = case
    pairs = spark.createDataFrame([(u, i) for u in users for i in items] + [(99, 7), (1, 5), (None, 7)], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in C.completed_scores(matrix, pairs).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == len(users) * len(items)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_top_k_is_that_of_the_product(case, k):
    users, items, matrix, want, _ = case
    got = {}
    for r in C.completed_top_k(matrix, k).collect():
        got.setdefault(r["user_id"], {})[r["rank"]] = r["item_id"]
    for u in users:
        best = sorted(items, key=lambda i: (-want[u, i], i))[:k]
        assert [got[u][r] for r in sorted(got[u])] == best


def test_ranks_are_those_of_the_product(spark, case):
    users, items, matrix, want, _ = case
    pairs = spark.createDataFrame([(u, i) for u in users for i in items], "user_id long, item_id long")
    got = {(r["user_id"], r["item_id"]): r["rank"] for r in C.completed_ranks(matrix, pairs).collect()}
    for u in users:
        for place, i in enumerate(sorted(items, key=lambda i: (-want[u, i], i)), 1):
            assert got[u, i] == place
    some = C.completed_ranks(matrix, pairs.where("user_id % 3 = 0 AND item_id % 2 = 0")).collect()
    assert some and all(got[r["user_id"], r["item_id"]] == r["rank"] for r in some)


def test_item_means_by_group(spark, case):
    users, items, matrix, want, fills = case
    groups = spark.createDataFrame([(u, u % 3 == 0) for u in users], "user_id long, sensitive boolean")
    rows = {r["item_id"]: r for r in C.completed_item_means(matrix, groups).collect()}
    assert sorted(rows) == items
    for i in items:
        for name, group in (("mean_true", True), ("mean_false", False)):
            own = [want[u, i] for u in users if fills[u] is not None and (u % 3 == 0) == group]
            assert rows[i][name] == pytest.approx(sum(own) / len(own), abs=1e-9)


def test_empty_tables(spark):
    users, items = spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([(5,), (6,), (8,)], "item_id long")
    none = spark.createDataFrame([], "user_id long, item_id long, score double")
    assert C.completed_top_k(C.complete(users, items, none), 2).count() == 4
    assert C.completed_top_k(C.complete(users, items.limit(0), none), 2).count() == 0
    assert C.completed_top_k(C.complete(users.limit(0), items, none), 2).count() == 0
    assert C.completed_ranks(C.complete(users, items, none), none.select("user_id", "item_id")).count() == 0
    assert [r["mean_true"] for r in C.completed_item_means(C.complete(users, items, none), users.selectExpr("user_id", "true AS sensitive")).collect()] == [None] * 3
