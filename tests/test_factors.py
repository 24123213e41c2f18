import random

import numpy as np

from evenkeel.plans import factors as X


def ratings(spark):
    rng = random.Random(4)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(12) for i in range(9) if rng.random() < 0.6]
    return rows, spark.createDataFrame(rows, "user_id long, item_id long, rating double")


def test_als_ends_at_a_fixed_point_of_the_normal_equations(spark):
    rows, df = ratings(spark)
    users, items, errors = X.fit_als(df, 2, 0.5, rounds=30, tolerance=1e-5)
    assert len(errors) > 2 and errors[-1] < errors[0]
    p, q = ({r[0]: np.array(r["vector"]) for r in t.collect()} for t in (users, items))
    assert abs(np.sqrt(np.mean([(p[u] @ q[i] - x) ** 2 for u, i, x in rows])) - errors[-1]) < 1e-9
    for i in q:
        own = [(p[u], x) for u, j, x in rows if j == i]
        a = sum(np.outer(v, v) for v, _ in own) + 0.5 * np.eye(2)
        assert np.allclose(q[i], np.linalg.solve(a, sum(v * x for v, x in own)))


def test_plsa_grows_until_it_hardly_does(spark):
    _, df = ratings(spark)
    events = df.withColumnRenamed("rating", "n")
    users, items, history = X.fit_plsa(events, 2, rounds=12, tolerance=1e-4)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:])) and len(history) > 1
    assert all(abs(r["s"] - 1) < 1e-9 for r in users.groupBy("user_id").agg({"p": "sum"}).toDF("user_id", "s").collect())
    assert all(abs(r["s"] - 1) < 1e-9 for r in items.groupBy("z").agg({"q": "sum"}).toDF("z", "s").collect())


def test_topic_steps_make_no_window_over_events(spark):
    """An event meets its topics as arrays: the joins and the norm once gave each event a row for every topic."""
    from pyspark.sql import functions as F

    from evenkeel.plans import factors

    events = spark.createDataFrame([(u, i, 1.0) for u in range(4) for i in range(3) if (u + i) % 2], "user_id long, item_id long, n double")
    z = F.explode(F.array(F.lit(0), F.lit(1))).alias("z")
    users = events.select("user_id").distinct().select("user_id", z).withColumn("p", (1 + (F.col("user_id") + F.col("z")) % 2) / 3.0)
    items = events.select("item_id").distinct().select("item_id", z).withColumn("q", (1 + (F.col("item_id") + F.col("z")) % 3) / 9.0)
    made = factors.plsa_step(events, users, items)
    p, q = {(r[0], r[1]): r[2] for r in users.collect()}, {(r[0], r[1]): r[2] for r in items.collect()}
    mass = {(u, t): 0.0 for u in range(4) for t in (0, 1)}
    for u, i, n in events.collect():
        for t in (0, 1):
            mass[u, t] += n * p[u, t] * q[i, t] / sum(p[u, s] * q[i, s] for s in (0, 1))
    for r in made[0].collect():
        assert abs(r["p"] - mass[r["user_id"], r["z"]] / (mass[r["user_id"], 0] + mass[r["user_id"], 1])) < 1e-9
    assert made[0]._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
