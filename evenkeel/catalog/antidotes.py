"""Made-up users' ratings moved against the variance of the groups' losses, one step with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.plans import antidote as A
from evenkeel.sources.views import Views

from .registry import query
from .views_sql import sql

RIDGE, START, STEPS = 2.0, 2.5, [0.0, 0.5, 2.5]

# Vectors have two elements, so the inverse of an item's matrix can be written out.
_STEP = """+ u AS (SELECT user_id, sensitive, 1.0::DOUBLE AS a, (user_id % 7) / 7.0::DOUBLE AS b FROM users),
f AS MATERIALIZED (SELECT age % 3 AS fake_id, 1.0::DOUBLE AS a, avg((user_id % 7) / 7.0::DOUBLE) AS b FROM users GROUP BY 1),
fs AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM f),
own AS (SELECT item_id, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(rating * a) AS ra, sum(rating * b) AS rb FROM train JOIN u USING (user_id) GROUP BY 1),
s AS MATERIALIZED (SELECT own.item_id, own.aa + fs.aa + 2 AS aa, own.ab + fs.ab AS ab, own.bb + fs.bb + 2 AS bb, ra, rb FROM own, fs),
x AS MATERIALIZED (SELECT item_id, fake_id, a, b, 2.5::DOUBLE AS rating FROM items, f),
v AS (SELECT s.*, aa * bb - ab * ab AS det, ra + xa AS pa, rb + xb AS pb FROM s JOIN (SELECT item_id, sum(rating * a) AS xa, sum(rating * b) AS xb FROM x GROUP BY 1) USING (item_id)),
e AS MATERIALIZED (SELECT t.item_id, u.sensitive, u.a, u.b, (u.a * (bb * pa - ab * pb) + u.b * (aa * pb - ab * pa)) / det - t.rating AS err FROM train t JOIN u ON u.user_id = t.user_id JOIN v ON v.item_id = t.item_id),
l AS (SELECT avg(err * err) FILTER (sensitive) AS l1, avg(err * err) FILTER (NOT sensitive) AS l0, count(*) FILTER (sensitive) AS n1, count(*) FILTER (NOT sensitive) AS n0 FROM e),
c AS (SELECT item_id, sum(a * p) AS ca, sum(b * p) AS cb FROM (SELECT e.*, (l1 - l0) * err * CASE WHEN sensitive THEN 1.0::DOUBLE / n1 ELSE -1.0::DOUBLE / n0 END AS p FROM e, l) GROUP BY 1),
g AS MATERIALIZED (SELECT x.item_id, x.fake_id, x.a, x.b, x.rating, (x.a * (bb * ca - ab * cb) + x.b * (aa * cb - ab * ca)) / det AS slope FROM x JOIN v ON v.item_id = x.item_id JOIN c ON c.item_id = x.item_id),
r AS MATERIALIZED (SELECT item_id, fake_id, a, b, rating, slope / (SELECT max(abs(slope)) FROM g) AS slope FROM g)"""


def _tables(v: Views):
    second = (F.col("user_id") % 7) / F.lit(7.0)
    users = v.users.select("user_id", "sensitive", F.array(F.lit(1.0), second).alias("vector"))
    fakes = v.users.groupBy((F.col("age") % 3).alias("fake_id")).agg(F.array(F.lit(1.0), F.avg(second)).alias("vector"))
    made = v.items.select("item_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fake_id")).withColumn("rating", F.lit(START))
    train = v.train.select("user_id", "item_id", "rating")
    return train, users, fakes, A.item_systems(train, users, fakes, 2, RIDGE), made


def _slopes(tables):
    return A.relative_slopes(A.antidote_slopes(*tables, 2))


@query("G13_antidote_slopes", sql(_STEP + " SELECT item_id, fake_id, round(slope + 1e-9::DOUBLE, 6) + 0.0::DOUBLE AS slope FROM r"))
def slopes(v: Views):
    """The derivative of the variance of the groups' losses by each made-up rating, in times of the largest."""
    return _slopes(_tables(v)).select("item_id", "fake_id", (F.round(F.col("slope") + 1e-9, 6) + F.lit(0.0)).alias("slope"))


@query("G13_antidote_losses", sql(_STEP + """, y AS (SELECT step, item_id, sum(greatest(least(rating - step * slope, 5), 0) * a) AS xa, sum(greatest(least(rating - step * slope, 5), 0) * b) AS xb
    FROM r, (SELECT unnest([0.0, 0.5, 2.5])::DOUBLE AS step) GROUP BY 1, 2),
w AS (SELECT step, s.*, aa * bb - ab * ab AS det, ra + xa AS pa, rb + xb AS pb FROM s JOIN y USING (item_id)),
z AS (SELECT step, u.sensitive, (u.a * (bb * pa - ab * pb) + u.b * (aa * pb - ab * pa)) / det - t.rating AS err FROM train t JOIN u ON u.user_id = t.user_id JOIN w ON w.item_id = t.item_id)
SELECT step, round(avg(err * err) FILTER (sensitive), 8) AS loss_true, round(avg(err * err) FILTER (NOT sensitive), 8) AS loss_false FROM z GROUP BY 1"""))
def losses(v: Views):
    """Both groups' losses after steps against the slopes."""
    train, users, fakes, systems, made = tables = _tables(v)
    rows = A.antidote_losses(train, users, fakes, systems, _slopes(tables), 2, STEPS)
    return rows.select("step", F.round("loss_true", 8).alias("loss_true"), F.round("loss_false", 8).alias("loss_false"))
