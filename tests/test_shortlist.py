"""Scores of candidates without a shuffle of pairs, and each user's best without pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.plans import fairness
from evenkeel.sources.views import Views


def _folder(spark, path, users, items, rows, ratings):
    """Tables in which every user has ``rows`` interactions; few ratings make many equal biases."""
    draw = random.Random(3)
    orders = [(u, u) for u in range(1, users + 1)]
    lines = [(u, i, float(10 * draw.choice(ratings))) for u, _ in orders for i in draw.sample(range(1, items + 1), rows)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.timestamp_seconds("o_orderkey")).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(u, u % 5) for u, _ in orders], "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    return Views(spark, str(path))


def _rows(df):
    return sorted(tuple(r) for r in df.select("user_id", "item_id", "score", "hit").collect())


@pytest.mark.parametrize("ratings", [(3,), (1, 5), (1, 2, 3, 4, 5)])
def test_shortlist_holds_the_best_of_all_pairs(spark, tmp_path, ratings):
    v = _folder(spark, tmp_path, 60, 3000, 40, ratings)
    all_rows = v.scored()
    places = [F.row_number().over(Window.partitionBy("user_id", "hit").orderBy(F.desc("score"), sign * F.col("item_id"))) for sign in (1, -1)]
    assert _rows(v.shortlist(3)) == _rows(all_rows.withColumn("r", places[0]).where("hit = 1 or r <= 3"))
    both = all_rows.withColumns({"a": places[0], "b": places[1]}).where("hit = 1 or a <= 3 or b <= 3")
    assert _rows(v.shortlist(3, ties=(1, -1))) == _rows(both)


def test_users_whom_the_lists_leave_in_doubt_get_all_pairs(spark, tmp_path, monkeypatch):
    from evenkeel.sources import views

    v = _folder(spark, tmp_path, 30, 2000, 40, (1, 5))
    first = views._first_of_classes
    monkeypatch.setattr(views, "_first_of_classes", lambda items, most, sign: first(items, 4, sign))
    place = F.row_number().over(Window.partitionBy("user_id", "hit").orderBy(F.desc("score"), "item_id"))
    assert _rows(v.shortlist(5)) == _rows(v.scored().withColumn("r", place).where("hit = 1 or r <= 5"))


def test_predictions_shuffle_no_pairs(spark, tmp_path):
    plan = _folder(spark, tmp_path, 30, 300, 20, (1, 5)).predictions._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("LeftOuter") == 0


def test_epsilon_fairness_reads_the_first_partners_first(spark):
    scored = spark.createDataFrame([(u, u % 2 == 0, i, float((u * i) % 7)) for u in range(8) for i in range(400)], "user_id long, sensitive boolean, item_id long, score double")
    asked = []

    def rows_of(first):
        asked.append(first.select("i1").distinct().count())
        return first.join(scored.select("user_id", "item_id", "score"), "user_id")

    value = fairness.epsilon_fairness(scored, max_pairs=10, rows_of=rows_of).first()["value"]
    assert asked == [1]
    pairs = [[[float((u * 0) % 7) > float((u * j) % 7) for u in range(8) if (u % 2 == 0) == g] for g in (True, False)] for j in range(1, 11)]
    assert value == pytest.approx(sum(abs(sum(a) / 4 - sum(b) / 4) for a, b in pairs) / 10)


def test_ties_of_solved_systems_round_away_from_zero(spark):
    """A system whose solution is -0.8046875 came out one unit of the last place nearer to zero."""
    from evenkeel.catalog.registry import settled

    rows = spark.createDataFrame([(-0.80468749999999978,), (0.80468749999999978,), (0.8046874999,)], "x double").select(settled(F.col("x")))
    assert [r[0] for r in rows.collect()] == [-0.804688, 0.804688, 0.804687]


def test_lists_are_sorted_once(spark, tmp_path):
    """Each reference to a user's list filtered and sorted it again."""
    plan = _folder(spark, tmp_path, 30, 300, 20, (1, 5)).shortlist(3, ties=(1, -1))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and "sort_array(" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_swaps_are_listed_once_and_those_of_the_rounds(spark, monkeypatch, seed):
    draw = random.Random(seed)
    rows = [(u, u % 3 > 0, i, draw.choice((1.0, 2.0, 2.5, 4.0)), int(draw.random() < (0.5 if u % 3 else 0.2))) for u in range(40) for i in draw.sample(range(50), draw.randint(2, 14))]
    made, real = [], fairness.kept
    monkeypatch.setattr(fairness, "kept", lambda table: made.append("item_id" in table.columns) or real(table))
    found = fairness.fair_rerank(spark.createDataFrame(rows, "user_id long, sensitive boolean, item_id long, score double, hit int"), 5, 0.0, "hit")
    lists = {u: [r for r in rows if r[0] == u] for u in range(40)}
    chosen = {u: set(sorted(own, key=lambda r: (-r[3], r[2]))[:5]) for u, own in lists.items()}
    for _ in range(5):
        hits = {g: [sum(r[4] for r in chosen[u]) for u in lists if (u % 3 > 0) == g] for g in (True, False)}
        gap = sum(hits[True]) / len(hits[True]) - sum(hits[False]) / len(hits[False])
        swaps = []
        for u in lists:
            out = sorted((r[3], r[2], r) for r in chosen[u] if r[4])
            into = sorted((r[3], r[2], r) for r in lists[u] if r not in chosen[u] and not r[4])
            if (u % 3 > 0) == (gap > 0) and out and into:
                swaps.append((out[0][0] - into[-1][0], u, out[0][2], into[-1][2]))
        if not gap or not swaps:
            break
        for _, u, out, into in sorted(swaps)[: math.ceil(abs(gap) * len(hits[gap > 0]) - 1e-9)]:
            chosen[u] = chosen[u] - {out} | {into}
    assert sorted(tuple(r) for r in found.select("user_id", "sensitive", "item_id", "score", "hit").collect()) == sorted(r for own in chosen.values() for r in own)
    assert made.count(True) == 1
