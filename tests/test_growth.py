"""Pairs of profiles, negatives, convolutions and top k whose shuffles and tasks stay in proportion to the tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import sampling
from evenkeel.operators.prepare import partner_sums
from evenkeel.plans import models, slim


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mirrored", [True, False])
@pytest.mark.parametrize("block", [1000, 3])
def test_partner_sums_are_all_pairs_in_tasks_that_grow(spark, mirrored, block):
    draw = random.Random(5)
    rows = [(u, i, float(draw.randint(1, 5)), float(i * 10)) for u in range(25) for i in draw.sample(range(30), draw.randint(1, 14))]
    of = defaultdict(list)
    for u, i, w, _ in rows:
        of[u].append((i, w))
    want, shared = Counter(), Counter()
    for profile in of.values():
        for i, w in profile:
            for j, x in profile:
                if (i != j) if mirrored else (i < j):
                    want[i, j] += w * x
                    shared[i, j] += 1
    table = spark.createDataFrame(rows, "u long, i long, w double, c double")
    found = partner_sums(table, "u", "i", "w", mirrored, "c", block, per_task=100)
    assert sorted(map(tuple, found.collect())) == sorted((i, j, g, i * 10.0, j * 10.0) for (i, j), g in want.items())
    assert found.rdd.getNumPartitions() >= sum(len(p) ** 2 for p in of.values()) // (100 if mirrored else 200)
    counted = partner_sums(table, "u", "i", mirrored=mirrored, block=block)
    assert sorted(map(tuple, counted.collect())) == sorted((i, j, n) for (i, j), n in shared.items())


def test_slim_systems_make_pairs_once(spark, monkeypatch):
    rows = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(12) for i in range(9) if (u + i) % 3], "user_id long, item_id long, rating double")
    made, real = [], slim.partner_sums
    monkeypatch.setattr(slim, "partner_sums", lambda *a, **b: made.append(1) or real(*a, **b))
    found = {r["target"]: r for r in slim.slim_systems(rows, "user_id", "item_id", 3).collect()}
    of = defaultdict(dict)
    for r in rows.collect():
        of[r["user_id"]][r["item_id"]] = r["rating"]
    for r in found.values():
        cells = {(c["x"], c["y"]): c["g"] for c in r["cells"]}
        for x in range(len(r["others"])):
            for y in range(x + 1, len(r["others"])):
                a, b = of[r["others"][x]], of[r["others"][y]]
                assert cells.get((x + 1, y + 1), 0.0) == sum(w * b[i] for i, w in a.items() if i in b)
    assert len(found) == 12 and len(made) == 1


def test_negatives_are_drawn_without_a_shuffle_of_draws(spark):
    items = spark.range(40).select(F.col("id").alias("item_id"))
    known = spark.createDataFrame([(u, i) for u in range(6) for i in range(40 - 8 * u) if u < 5 or i > 3], "user_id long, item_id long")
    positives = known.where("item_id % 3 = 0").union(spark.createDataFrame([(9, 7)], "user_id long, item_id long"))
    found = sampling.negatives(positives, items, known, 4)
    assert "LeftAnti" not in _plan(found) and "Window" not in _plan(found)
    has, met = defaultdict(list), defaultdict(set)
    for r in found.collect():
        has[r["user_id"], r["item_id"]].append(r["negative_id"])
    for r in known.collect():
        met[r["user_id"]].add(r["item_id"])
    for u, i in map(tuple, positives.collect()):
        got = has[u, i]
        assert len(set(got)) == len(got) == min(4, 40 - len(met[u])) and not set(got) & met[u]


def test_convolution_shuffles_vectors_whole(spark):
    edges = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (2, 2, 1.0), (3, 9, 1.0)], "u long, i long, w double")
    vectors = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [8.0, 16.0])], "i long, vector array<float>")
    out = models.graph_convolution(edges, vectors, "u", "i", F.col("w"))
    assert {r["u"]: r["vector"] for r in out.collect()} == {1: [2.5, 5.0, 2.0], 2: [8.0, 16.0]}
    assert "posexplode" not in _plan(out)


def test_top_k_by_matrix_products_is_that_of_rounded_scores(spark, monkeypatch):
    draw = random.Random(2)
    vectors = [[draw.choice((0.5, 0.500001, -1.0, 2.0)) for _ in range(4)] for _ in range(300)]
    e = spark.createDataFrame([*enumerate(vectors), (300, None), (301, [1.0])], "id long, e array<double>")
    monkeypatch.setattr(models, "dot", None)  # no product element by element for each pair
    found = models.dot_product_top_k(e.where("id % 30 = 0 AND id < 300").selectExpr("id AS query_id", "e AS q"), e.selectExpr("id AS item_id", "e AS v"), 5, 2, 3)
    want = []
    for q in range(0, 300, 30):
        scores = sorted((-round(sum(a * b for a, b in zip(vectors[q], v)), 5), i) for i, v in enumerate(vectors))
        want += [(q, i, -s, r) for r, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
