import random
from itertools import combinations, product

import numpy as np
import pytest

from evenkeel.plans import folds as O
from evenkeel.plans import matrix_factors as M
from evenkeel.plans import rerank as D
from evenkeel.plans import slim as L


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(u, i, float(rng.randint(1, 5))) for u in range(14) for i in range(10) if rng.random() < 0.6]


@pytest.fixture(scope="module")
def ratings(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double").cache()


@pytest.mark.parametrize("l3", [0.0, 4.0])
def test_slim_weights_meet_the_optimality_conditions(spark, rows, ratings, l3):
    """No coordinate of any target can move for the better: the KKT conditions of its whole neighbourhood."""
    l1, l2, k = 2.0, 1.5, 5
    sign = {u: 1.0 if u % 3 else -1.0 for u in range(13)}  # user 13 has no group
    signs = spark.createDataFrame(list(sign.items()), "user_id long, sign double")
    systems = L.slim_systems(ratings, "user_id", "item_id", k, signs)
    got = {}
    for r in L.slim_weights(systems, l1, l2, l3, passes=500).collect():
        got.setdefault(r["target"], {})[r["other"]] = r["weight"]
    r = np.zeros((14, 10))
    for u, i, x in rows:
        r[u, i] = x
    g = r @ r.T
    for u in range(14):
        others = sorted((v for v in range(14) if v != u and g[u, v] > 0), key=lambda v: (-round(g[u, v] / np.sqrt(g[u, u] * g[v, v]), 6), v))[:k]
        w = np.array([got.get(u, {}).get(v, 0.0) for v in others])
        s = np.array([sign.get(v, 0.0) for v in others])
        slope = g[np.ix_(others, others)] @ w - g[others, u] + l2 * w + l3 * s * (s @ w)
        assert all(abs(d + l1 * np.sign(x)) < 1e-5 if x else abs(d) <= l1 + 1e-5 for d, x in zip(slope, w))
        assert set(got.get(u, {})) <= set(others)
    scores = L.slim_scores(ratings, L.slim_weights(systems, l1, l2, l3), ratings.select("user_id", "item_id"), "user_id", "item_id").collect()
    for x in scores:
        assert abs(x["score"] - sum(w * r[v, x["item_id"]] for v, w in got[x["user_id"]].items())) < 1e-6


def best_lists(rows, k, epsilon, metric):
    """The best feasible value by trying all lists of all users; null if there are none."""
    users = {}
    for u, i, s, label, g in rows:
        users.setdefault((u, g), []).append((s, label))
    size = {g: sum(1 for (_, h), c in users.items() if h == g and sum(x for _, x in c)) for g in (True, False)}
    options = []
    for (_, g), c in users.items():
        total = sum(x for _, x in c)
        seen = {}
        for chosen in combinations(c, min(k, len(c))):
            hits = sum(x for _, x in chosen)
            share = {"precision": hits / k, "recall": hits / total if total else 0, "f1": 2 * hits / (total + k)}[metric] if total else 0
            key = (1 if g else -1) * share / (size[g] or 1)
            seen[key] = max(seen.get(key, -1e9), sum(s for s, _ in chosen))
        options.append(seen)
    best = None
    for pick in product(*[o.items() for o in options]):
        if abs(sum(p for p, _ in pick)) <= epsilon + 1e-9:
            best = max(best if best is not None else -1e9, sum(v for _, v in pick))
    return best


@pytest.mark.parametrize("metric,epsilon,seed", [("precision", 0.05, 1), ("recall", 0.3, 2), ("f1", 0.1, 3), ("precision", 10.0, 4), ("recall", 0.0, 5)])
def test_dual_rerank_is_certified(spark, metric, epsilon, seed):
    rng = random.Random(seed)
    rows = [(u, i, round(rng.random() + (0.5 if g and label else 0), 3), label, g) for u in range(6) for g in [u % 2 == 0] for i in range(5) for label in [int(rng.random() < 0.45)]]
    lists, found = D.dual_rerank(spark.createDataFrame(rows, "user_id long, item_id long, score double, label int, sensitive boolean"), 2, epsilon, metric)
    got = lists.collect()
    by_user = {}
    for r in got:
        by_user.setdefault(r["user_id"], []).append(r)
    assert all(len(c) == 2 for c in by_user.values()) and len(by_user) == 6
    best = best_lists(rows, 2, epsilon, metric)
    if found.feasible:
        assert abs(sum(r["score"] for r in got) - found.value) < 1e-9
        assert best is None or found.bound >= best - 1e-6  # no feasible lists are above the bound
        if abs(found.gap) <= epsilon + 1e-9:
            assert found.value <= best + 1e-9 <= found.bound + 1e-6
    else:
        assert best is None


def test_dual_rerank_says_what_cannot_be_met(spark):
    rows = [(1, i, 1.0 - i / 10, 1, True) for i in range(3)] + [(2, i, 1.0, int(i == 0), False) for i in range(9)]
    lists, found = D.dual_rerank(spark.createDataFrame(rows, "user_id long, item_id long, score double, label int, sensitive boolean"), 3, 0.1)
    assert not found.feasible and found.gap > 0.1 and lists.count() == 6
    empty, none = D.dual_rerank(spark.createDataFrame([], "user_id long, item_id long, score double, label int, sensitive boolean"), 3, 0.1)
    assert none.feasible and empty.count() == 0


def unpacked(table, n, k):
    out = np.zeros((n, k + 1))
    for r in table.collect():
        out[r[0]] = r["v"]
    return out


def test_conjugate_gradients_end_where_numpy_finds_no_slope(rows, ratings):
    k, penalty = 1, 8.0
    fit = M.fit_factors(ratings, k, penalty, rounds=6, tolerance=1e-4)
    assert all(b <= a + 1e-9 for a, b in zip(fit.losses, fit.losses[1:])) and fit.slopes[-1] < 0.02 * fit.slopes[0]
    u, i = unpacked(fit.factors.users, 14, k), unpacked(fit.factors.items, 10, k)

    def loss(mu, u, i):
        e = sum((mu + u[a, 0] + i[b, 0] + u[a, 1:] @ i[b, 1:] - x) ** 2 for a, b, x in rows)
        return 0.5 * e + 0.5 * penalty * ((u**2).sum() + (i**2).sum())

    assert abs(loss(fit.factors.mu, u, i) - fit.losses[-1]) < 1e-6 * fit.losses[-1]
    _, users, items = M.gradient(ratings, fit.factors, k, penalty)
    for r in users.collect()[:3]:  # against finite differences
        for j in range(k + 1):
            up, down = u.copy(), u.copy()
            up[r[0], j] += 1e-5
            down[r[0], j] -= 1e-5
            assert abs((loss(fit.factors.mu, up, i) - loss(fit.factors.mu, down, i)) / 2e-5 - r["g"][j]) < 1e-4
    one = {(r["user_id"], r["item_id"]): r["score"] for r in M.scored(ratings, fit.factors, k).collect()}
    assert all(abs(one[a, b] - (fit.factors.mu + u[a, 0] + i[b, 0] + u[a, 1:] @ i[b, 1:])) < 1e-9 for a, b, _ in rows)


def test_best_step_is_the_least_of_a_quartic():
    assert abs(M.best_step([1.0, -4.0, 2.0, 0.0, 0.0]) - 1) < 1e-9 and M.best_step([1.0, 0.0, 0.0, 0.0, 0.0]) == 0
    c = [0.3, -1.0, 0.2, -0.7, 0.5]
    t = M.best_step(c)
    assert all(np.polyval(c[::-1], t) <= np.polyval(c[::-1], x) + 1e-9 for x in np.linspace(-4, 4, 4001))


def test_logistic_fit_falls_to_a_point_without_slope(ratings, rows):
    from pyspark.sql import functions as F

    labels = ratings.select("user_id", "item_id", (F.col("rating") > 3).cast("int").alias("label"))
    users, items, losses = M.fit_logistic(labels, 2, 0.5, rounds=4, tolerance=1e-3)
    assert len(losses) > 2 and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    p, q = ({r[0]: np.array(r["vector"]) for r in t.collect()} for t in (users, items))
    want = sum(np.log1p(np.exp(-(2 * (x > 3) - 1) * (p[a] @ q[b]))) for a, b, x in rows) + 0.25 * sum(v @ v for t in (p, q) for v in t.values())
    assert abs(want - losses[-1]) < 1e-6 * want
    aim = {r[0]: np.array(r["vector"]) for r in M.logistic_half_step(labels, items, users, "item_id", "user_id", 2, 0.5).collect()}
    for b in list(q)[:4]:
        own = [(p[a], float(x > 3)) for a, c, x in rows if c == b]
        s = [1 / (1 + np.exp(-(v @ q[b]))) for v, _ in own]
        slope = sum((g - y) * v for g, (v, y) in zip(s, own)) + 0.5 * q[b]
        bend = sum(g * (1 - g) * np.outer(v, v) for g, (v, _) in zip(s, own)) + 0.5 * np.eye(2)
        assert np.allclose(aim[b], q[b] - np.linalg.solve(bend, slope), atol=1e-6)  # Newton's step


def test_implicit_half_step_counts_all_pairs(spark, rows, ratings):
    users = {u: np.array([1.0, (u % 5) / 5 - 0.3]) for u in range(20)}  # six of them rate nothing
    fixed = spark.createDataFrame([(u, v.tolist()) for u, v in users.items()], "user_id long, vector array<double>")
    got = {r[0]: np.array(r["vector"]) for r in M.implicit_half_step(ratings, fixed, "item_id", "user_id", 2, 0.3, 7.0).collect()}
    for i in range(10):
        seen = {u for u, j, _ in rows if j == i}
        a = sum((8.0 if u in seen else 1.0) * np.outer(v, v) for u, v in users.items()) + 0.3 * np.eye(2)
        assert np.allclose(got[i], np.linalg.solve(a, sum(8.0 * users[u] for u in seen)))


def test_folds_are_those_fitted_one_by_one(spark, rows):
    from statistics import mean

    rng = random.Random(6)
    all_rows = [(u, i, x, u % 2 == 0, rng.randrange(3)) for u, i, x in rows]
    got = {(r["fold"], r["adjustment"]): r for r in O.fold_report(spark.createDataFrame(all_rows, "user_id long, item_id long, rating double, sensitive boolean, fold long"), 3).collect()}
    assert len(got) == 12
    for f in range(3):
        train, held = [r for r in all_rows if r[4] != f], [r for r in all_rows if r[4] == f]
        mu = mean(r[2] for r in train)
        bias = lambda k, x: mean([r[2] - mu for r in train if r[k] == x] or [0.0])
        score = lambda r: mu + bias(0, r[0]) + bias(1, r[1])
        gap = mean(score(r) for r in train if r[3]) - mean(score(r) for r in train if not r[3])

        def value(r):
            errors = {g: [x[2] - score(x) for x in train if x[1] == r[1] and x[3] == g] for g in (True, False)}
            return mean(errors[r[3]]) if errors[True] and errors[False] else 0.0

        moves = {"none": lambda r: 0.0, "value": value, "parity": lambda r: -gap if r[3] else 0.0, "parity_half": lambda r: -gap / 2 if r[3] else gap / 2}
        for name, move in moves.items():
            out = [(score(r) + move(r), r) for r in held]
            assert abs(got[f, name]["rmse"] - mean((s - r[2]) ** 2 for s, r in out) ** 0.5) < 1e-9 and got[f, name]["n"] == len(held)
            assert abs(got[f, name]["difference"] - (mean(s for s, r in out if r[3]) - mean(s for s, r in out if not r[3]))) < 1e-9


def test_folds_deal_rows_by_user_and_item_once(spark):
    """Copies of the rows for each fold were dealt by fold and entity."""
    import re

    rows = spark.range(60).selectExpr("id % 7 AS user_id", "id % 11 AS item_id", "CAST(id % 5 AS DOUBLE) AS rating", "id % 2 = 0 AS sensitive", "id % 3 AS fold")
    dealt = re.findall(r"Exchange hashpartitioning\((.*?)\)", O.fold_report(rows, 3)._jdf.queryExecution().executedPlan().toString())
    assert not [x for x in dealt if "fold" in x and ("item_id" in x or "user_id" in x)]


def test_user_neighbours_and_scores(rows, ratings):
    from evenkeel.plans import models as G

    r = np.zeros((14, 10))
    for u, i, x in rows:
        r[u, i] = x
    unit = r / np.linalg.norm(r, axis=1)[:, None]
    near = G.user_neighbours(ratings, 3)
    got = {}
    for x in near.collect():
        got.setdefault(x["user_id"], {})[x["other_id"]] = x["similarity"]
    mean = {u: r[u][r[u] > 0].mean() for u in range(14)}
    for u in range(14):
        best = sorted(((-round(unit[u] @ unit[v], 6), v) for v in range(14) if v != u and unit[u] @ unit[v] > 0))[:3]
        assert {v: -s for s, v in best} == pytest.approx(got[u])
    for x in G.user_knn_scores(ratings, ratings.select("user_id", "item_id"), near).collect():
        own = {v: s for v, s in got[x["user_id"]].items() if r[v, x["item_id"]] > 0}
        want = mean[x["user_id"]] + sum(s * (r[v, x["item_id"]] - mean[v]) for v, s in own.items()) / sum(own.values())
        assert abs(x["score"] - want) < 1e-9


def test_features_each_take_error_away(ratings, rows):
    from evenkeel.plans import models as G

    users, items, errors = G.fit_features(ratings, 2, 0.3, rounds=2)
    p, q = ({x[0]: np.array(x["values"]) for x in t.collect()} for t in (users, items))
    biased = {(x["user_id"], x["item_id"]): x["score"] for x in G.bias_scores(ratings, ratings.select("user_id", "item_id")).collect()}
    left = {(x["user_id"], x["item_id"]): x["e"] for x in errors.collect()}
    for u, i, x in rows:
        assert abs(x - biased[u, i] - p[u] @ q[i] - left[u, i]) < 1e-9
    square = lambda e: sum(x * x for x in e)
    one = [x - biased[u, i] - p[u][0] * q[i][0] for u, i, x in rows]
    assert square(left.values()) < square(one) < square(x - biased[u, i] for u, i, x in rows)


def test_classifier_is_where_numpy_finds_no_slope(spark):
    from evenkeel.plans import inference as I

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.0, 0.5] + 0.3 + rng.normal(size=300) > 0).astype(int)
    rows = [(a.tolist(), int(b)) for a, b in zip(x, y)] + [(None, 1), (x[0].tolist(), None)]
    w = np.array(I.fit_classifier(spark.createDataFrame(rows, "x array<double>, y int").repartition(3), ridge=0.7))
    whole = np.column_stack([np.ones(300), x])
    p = 1 / (1 + np.exp(-whole @ w))
    assert np.allclose(whole.T @ (p - y) + 0.7 * np.array([0, *w[1:]]), 0, atol=1e-6)
    got = I.inferred(spark.createDataFrame(rows[:300], "x array<double>, y int"), w.tolist()).collect()
    assert np.allclose(sorted(r["s"] for r in got), sorted(whole @ w))
    assert I.fit_classifier(spark.createDataFrame([], "x array<double>, y int")) == [0.0]


def test_sentences_hold_where_some_clause_does(spark):
    from pyspark.sql import functions as F

    from evenkeel.plans import sentences as S

    made = S.made_sentences(spark.range(-5, 300), "id", variables=6, most_clauses=4, most_literals=2)
    true = {1, 4}
    out = made.select("clauses", S.sentence_text(F.col("clauses")).alias("text"), S.holds(F.col("clauses"), F.array(*map(F.lit, sorted(true)))).alias("truth")).collect()
    assert {len(r["clauses"]) for r in out} == {1, 2, 3, 4} and {len(c) for r in out for c in r["clauses"]} == {1, 2}
    for r in out:
        read = [[(x.lstrip("~"), x.startswith("~")) for x in c.split("^")] for c in r["text"].split("v")]
        assert [[-int(v) - 1 if no else int(v) for v, no in c] for c in read] == r["clauses"]
        assert r["truth"] == any(all((int(v) in true) != no for v, no in c) for c in read)
    assert {r["truth"] for r in out} == {True, False}
