import random

import numpy as np
import pytest

from evenkeel.plans import antidote as A

RANK, RIDGE = 3, 0.7


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(12)
    vectors = {u: [rng.uniform(-1, 1.5) for _ in range(RANK)] for u in range(16)}
    groups = {u: None if u == 15 else u % 3 == 0 for u in vectors}
    fakes = {f: [rng.uniform(-1, 1.5) for _ in range(RANK)] for f in range(3)}
    ratings = [(u, i, float(rng.randint(1, 5))) for u in vectors for i in range(8) if i < 7 and rng.random() < 0.6]
    made = {(i, f): rng.uniform(0.5, 4.5) for i in range(8) for f in fakes}
    frames = (
        spark.createDataFrame(ratings, "user_id long, item_id long, rating double").repartition(3),
        spark.createDataFrame([(u, groups[u], x) for u, x in vectors.items()], "user_id long, sensitive boolean, vector array<double>"),
        spark.createDataFrame(list(fakes.items()), "fake_id long, vector array<double>"),
        spark.createDataFrame([(i, f, x) for (i, f), x in made.items()], "item_id long, fake_id long, rating double"),
    )

    def losses(ratings_of_fakes):
        out = {True: [], False: []}
        for i in range(8):
            own = [(vectors[u], r, groups[u]) for u, j, r in ratings if j == i]
            rows = np.array([x for x, _, _ in own] + list(fakes.values()))
            right = np.array([r for _, r, _ in own] + [ratings_of_fakes[i, f] for f in fakes])
            v = np.linalg.solve(rows.T @ rows + RIDGE * np.eye(RANK), rows.T @ right)
            for x, r, g in own:
                if g is not None:
                    out[g].append((np.dot(x, v) - r) ** 2)
        return np.mean(out[True]), np.mean(out[False])

    return frames, made, losses


def variance(losses):
    return ((losses[0] - losses[1]) / 2) ** 2


def test_slopes_are_finite_differences(case):
    (ratings, users, fakes, made), start, losses = case
    systems = A.item_systems(ratings, users, fakes, RANK, RIDGE)
    got = {(r["item_id"], r["fake_id"]): r["slope"] for r in A.antidote_slopes(ratings, users, fakes, systems, made, RANK).collect()}
    assert set(got) == {k for k in start if k[0] < 7}  # item 7 has no ratings
    for key, slope in got.items():
        up, down = ({**start, key: start[key] + d} for d in (1e-4, -1e-4))
        assert slope == pytest.approx((variance(losses(up)) - variance(losses(down))) / 2e-4, rel=1e-4, abs=1e-9)


def test_losses_along_the_slopes(case):
    (ratings, users, fakes, made), start, losses = case
    systems = A.item_systems(ratings, users, fakes, RANK, RIDGE)
    slopes = A.relative_slopes(A.antidote_slopes(ratings, users, fakes, systems, made, RANK)).cache()
    way = {(r["item_id"], r["fake_id"]): r["slope"] for r in slopes.collect()}
    assert max(map(abs, way.values())) == pytest.approx(1)
    for r in A.antidote_losses(ratings, users, fakes, systems, slopes, RANK, [0.0, 1.0, 9.0]).collect():
        moved = {k: min(max(x - r["step"] * way.get(k, 0.0), 0.0), 5.0) for k, x in start.items()}
        assert (r["loss_true"], r["loss_false"]) == pytest.approx(losses(moved), rel=1e-9)


def test_rounds_bring_the_groups_together(case):
    (ratings, users, fakes, made), start, losses = case
    best, history = A.fit_antidote(ratings, users, fakes, made, RANK, RIDGE, [0.1, 0.5, 2.0], rounds=3)
    assert history[0] == pytest.approx(variance(losses(start))) and len(history) > 1
    assert all(a > b for a, b in zip(history, history[1:]))
    got = {(r["item_id"], r["fake_id"]): r["rating"] for r in best.collect()}
    assert all(0 <= x <= 5 for x in got.values()) and variance(losses({**start, **got})) == pytest.approx(history[-1])


def test_nothing_to_move(case):
    (ratings, users, fakes, made), _, _ = case
    for none in (ratings.limit(0), ratings.where("user_id % 3 = 0 AND user_id < 15")):
        assert A.fit_antidote(none, users, fakes, made, RANK, RIDGE, [1.0], rounds=1)[1] == []
