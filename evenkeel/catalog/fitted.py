"""Fitted recommenders: sparse linear neighbours, re-ranking by the dual, factors, folds and topics by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.operators.numbering import kept
from evenkeel.plans import factors as X
from evenkeel.plans import matrix_factors as M
from evenkeel.plans import models as G
from evenkeel.plans import rerank as D
from evenkeel.plans import slim as L
from evenkeel.sources.views import Views

from .registry import query, r6
from .views_sql import SCORED, sql

# Sparse linear neighbours

_SLIM = sql("""+ r AS MATERIALIZED (SELECT user_id, item_id, rating FROM train), norms AS MATERIALIZED (SELECT user_id, sum(rating * rating) AS norm FROM r GROUP BY 1),
gram AS MATERIALIZED (SELECT a.user_id AS i1, b.user_id AS i2, sum(a.rating * b.rating) AS g FROM r a JOIN r b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT * FROM (SELECT i1 AS target, i2 AS other, g, b.norm, CASE WHEN u.sensitive THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign,
    row_number() OVER (PARTITION BY i1 ORDER BY round(g / sqrt(a.norm * b.norm), 6) DESC, i2) AS rank
    FROM gram JOIN norms a ON a.user_id = i1 JOIN norms b ON b.user_id = i2 JOIN users u ON u.user_id = i2) WHERE rank <= 8),
cells AS (SELECT x.target, x.rank AS x, list(CASE WHEN x.rank = y.rank THEN x.norm ELSE coalesce(c.g, 0) END ORDER BY y.rank) AS line
    FROM near x JOIN near y ON x.target = y.target LEFT JOIN gram c ON c.i1 = x.other AND c.i2 = y.other GROUP BY 1, 2),
systems AS MATERIALIZED (SELECT n.target, list(other ORDER BY rank) AS others, list(g ORDER BY rank) AS products, list(sign ORDER BY rank) AS signs, list(line ORDER BY rank) AS m
    FROM near n JOIN cells c ON c.target = n.target AND c.x = n.rank GROUP BY 1),
descent AS (
    SELECT target, 0 AS step, list_transform(others, lambda x: 0.0::DOUBLE) AS w FROM systems
    UNION ALL
    SELECT target, step + 1, list_transform(w, lambda x, i: CASE WHEN i = c THEN sign(rest) * greatest(abs(rest) - 1, 0) / (m[c][c] + 5 + 2) ELSE x END) FROM (
        SELECT d.*, s.m, c, products[c] - list_dot_product(m[c], w) + m[c][c] * w[c] - 2 * signs[c] * (list_dot_product(signs, w) - signs[c] * w[c]) AS rest
        FROM (SELECT *, step % len(w) + 1 AS c FROM descent WHERE step < 2 * len(w)) d JOIN systems s USING (target))
), weights AS MATERIALIZED (
    SELECT * FROM (SELECT target, unnest(others) AS other, unnest(w) AS weight FROM descent JOIN systems USING (target) WHERE step = 2 * len(w)) WHERE weight <> 0)""").replace("WITH", "WITH RECURSIVE", 1)


def _slim(v: Views):
    signs = v.users.select("user_id", F.when(F.col("sensitive"), 1.0).otherwise(-1.0).alias("sign"))
    return L.slim_weights(L.slim_systems(v.train, "user_id", "item_id", 8, signs), 1.0, 5.0, 2.0, passes=2)


@query("G22_slim_weights", _SLIM + " SELECT target, other, round(weight, 6) AS weight FROM weights")
def slim_weights(v: Views):
    """Two passes of coordinate descent over each user's 8 nearest neighbours, balanced between the groups."""
    return _slim(v).select("target", "other", r6("weight"))


@query("G22_slim_scores", _SLIM + " SELECT t.user_id, t.item_id, round(sum(weight * r.rating), 5) AS score FROM test t JOIN weights w ON w.target = t.user_id JOIN r ON r.user_id = w.other AND r.item_id = t.item_id GROUP BY 1, 2")
def slim_scores(v: Views):
    train = v.train
    return L.slim_scores(train, _slim(v), v.test.select("user_id", "item_id"), "user_id", "item_id").withColumn("score", F.round("score", 5))


# Re-ranking by the dual

_PRICED = """+ c AS (SELECT user_id, item_id, score, sensitive, (rating IS NOT NULL)::INT AS label FROM scored),
n AS (SELECT sensitive, count(DISTINCT user_id) AS n FROM c WHERE label > 0 GROUP BY 1),
priced AS MATERIALIZED (SELECT c.*, CASE WHEN c.sensitive THEN 1 ELSE -1 END * (label / 10.0::DOUBLE) / n AS price FROM c LEFT JOIN n ON n.sensitive = c.sensitive),
moved AS (SELECT priced.*, l, round(score - l * price, 9) AS moved FROM priced, (SELECT unnest([-4000.0, 0.0, 1500.0, 9000.0])::DOUBLE AS l)),
lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, l ORDER BY moved DESC, item_id) AS place FROM moved) WHERE place <= 10)"""
_MULTIPLIERS = [-4000.0, 0.0, 1500.0, 9000.0]


def _candidates(v: Views):
    return v.shortlist(10, v.users.select("user_id", "sensitive")).withColumnRenamed("hit", "label")


@query("G15_dual_values", sql(_PRICED + " SELECT l AS multiplier, round(sum(score), 3) AS value, round(sum(price), 8) AS gap, round(sum(score) - l * sum(price) + abs(l) * 0.01, 3) AS bound FROM lists GROUP BY l", SCORED))
def dual_values(v: Views):
    """Value, gap and bound of the lists at four multipliers."""
    rows = D.dual_values(D.priced(_candidates(v), 10), 10, 0.01, _MULTIPLIERS)
    return rows.select("multiplier", F.round("value", 3).alias("value"), F.round("gap", 8).alias("gap"), F.round("bound", 3).alias("bound"))


@query("G15_lists_at_multiplier", sql(_PRICED + " SELECT user_id, item_id, label, place::INT AS place FROM lists WHERE l = 1500", SCORED))
def lists_at_multiplier(v: Views):
    return D.lists_at(D.priced(_candidates(v), 10), 10, [1500.0]).select("user_id", "item_id", "label", "place")


@query("G15_dual_reranking")
def dual_reranking(v: Views):
    """Lists whose groups differ by 0.001 at most; each row has how much better the best lists can be at most."""
    lists, found = D.dual_rerank(_candidates(v), 10, 0.001)
    return lists.withColumns({"gap": F.lit(found.gap), "missing": F.lit(found.missing), "feasible": F.lit(found.feasible)})


# Matrix factorisation

_START = """+ r AS MATERIALIZED (SELECT user_id, item_id, rating FROM train), m AS (SELECT avg(rating) AS mu FROM r),
bu AS (SELECT user_id, avg(rating - mu) AS b FROM r, m GROUP BY 1), bi AS (SELECT item_id, avg(rating - mu - b) AS b FROM r JOIN bu USING (user_id), m GROUP BY 1),
p AS MATERIALIZED (SELECT user_id, b, ((user_id * 7919 + 104729) % 1009 / 1008.0::DOUBLE - 0.5) * 0.2 AS p1, ((user_id * 7919 + 209458) % 1009 / 1008.0::DOUBLE - 0.5) * 0.2 AS p2 FROM bu),
q AS MATERIALIZED (SELECT item_id, b, ((item_id * 7919 + 104729) % 1009 / 1008.0::DOUBLE - 0.5) * 0.2 AS q1, ((item_id * 7919 + 209458) % 1009 / 1008.0::DOUBLE - 0.5) * 0.2 AS q2 FROM bi),
e AS MATERIALIZED (SELECT user_id, item_id, p.b AS b, q.b AS c, p1, p2, q1, q2, mu + p.b + q.b + p1 * q1 + p2 * q2 - rating AS e FROM r JOIN p USING (user_id) JOIN q USING (item_id), m),
gu AS MATERIALIZED (SELECT user_id, sum(e) + 0.1 * any_value(b) AS g0, sum(e * q1) + 0.1 * any_value(p1) AS g1, sum(e * q2) + 0.1 * any_value(p2) AS g2 FROM e GROUP BY 1),
gi AS MATERIALIZED (SELECT item_id, sum(e) + 0.1 * any_value(c) AS g0, sum(e * p1) + 0.1 * any_value(q1) AS g1, sum(e * p2) + 0.1 * any_value(q2) AS g2 FROM e GROUP BY 1)"""


@query("G6_factor_gradient", sql(_START + " SELECT 'user' AS kind, user_id AS id, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2 FROM gu UNION ALL SELECT 'item', item_id, round(g0, 6), round(g1, 6), round(g2, 6) FROM gi"))
def factor_gradient(v: Views):
    """The gradient at the start of the fit."""
    train = v.train
    _, users, items = M.gradient(train, M.start_factors(train, 2), 2, 0.1)
    each = [t.select(F.lit(kind).alias("kind"), F.col(c).alias("id"), *[r6(F.get("g", F.lit(j)), f"g{j}") for j in range(3)]) for t, kind, c in ((users, "user", "user_id"), (items, "item", "item_id"))]
    return each[0].union(each[1])


@query("G6_line_coefficients", sql(_START + """, d AS (SELECT e.*, -(SELECT sum(e) FROM e) - gu.g0 - gi.g0 - gu.g1 * q1 - gu.g2 * q2 - gi.g1 * p1 - gi.g2 * p2 AS x, gu.g1 * gi.g1 + gu.g2 * gi.g2 AS y FROM e JOIN gu USING (user_id) JOIN gi USING (item_id)),
s AS (SELECT sum(v) AS vv, sum(w) AS vd, sum(z) AS dd FROM (SELECT b * b + p1 * p1 + p2 * p2 AS v, -(b * g0 + p1 * g1 + p2 * g2) AS w, g0 * g0 + g1 * g1 + g2 * g2 AS z FROM p JOIN gu USING (user_id)
    UNION ALL SELECT b * b + q1 * q1 + q2 * q2, -(b * g0 + q1 * g1 + q2 * g2), g0 * g0 + g1 * g1 + g2 * g2 FROM q JOIN gi USING (item_id)))
SELECT unnest([0, 1, 2, 3, 4])::INT AS power, unnest([round((sum(e * e) + 0.1 * any_value(vv)) / 2, 3), round(sum(e * x) + 0.1 * any_value(vd), 3), round((sum(x * x + 2 * e * y) + 0.1 * any_value(dd)) / 2, 1), round(sum(x * y), 0), round(sum(y * y) / 2, 0)]) AS coefficient FROM d, s"""))
def line_coefficients(v: Views):
    """The loss along the first direction, the gradient's opposite, as a polynomial of the step."""
    train = kept(v.train.select("user_id", "item_id", "rating"))
    start = M.start_factors(train, 2)
    start = M.Factors(start.mu, kept(start.users), kept(start.items))
    mean, users, items = M.gradient(train, start, 2, 0.1)
    down = lambda t, key: t.select(key, F.transform("g", lambda x: -x).alias("v"))
    found = M.line_coefficients(train, start, M.Factors(-mean.first()[0], down(users, "user_id"), down(items, "item_id")), 2, 0.1)
    places = [3, 3, 1, 0, 0]
    return found.select(F.inline(F.array(*[F.struct(F.lit(n).alias("power"), F.round(f"c{n}", p).alias("coefficient")) for n, p in enumerate(places)])))


@query("G6_fitted_scores")
def fitted_scores(v: Views):
    """Scores of the test pairs after three rounds of conjugate gradients; tests compare the fit with NumPy."""
    train = v.train
    fit = M.fit_factors(train, 2, 0.1, rounds=3)
    return M.scored(v.test.select("user_id", "item_id"), fit.factors, 2).select("user_id", "item_id", r6("score"))


_LABELS = """+ r AS MATERIALIZED (SELECT user_id, item_id, (rating > 3)::INT AS label, CASE WHEN u.sensitive THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS x FROM train JOIN users u USING (user_id))"""


@query("G8_logistic_half_step", sql(_LABELS + """, e AS (SELECT item_id, x, 1 / (1 + exp(-0.2 * (1 + x))) AS p, 0.2 * (1 + x) AS s, label FROM r), w AS (SELECT *, p * (1 - p) AS w, s + (label - p) / (p * (1 - p)) AS z FROM e),
n AS (SELECT item_id, sum(w) + 0.5 AS a, sum(w * x) AS b, sum(w * x * x) + 0.5 AS d, sum(w * z) AS y, sum(w * z * x) AS yx FROM w GROUP BY 1)
SELECT item_id, round((y * d - b * yx) / (a * d - b * b), 6) AS v0, round((a * yx - b * y) / (a * d - b * b), 6) AS v1 FROM n"""))
def logistic_half_step(v: Views):
    """Item vectors after one reweighted step for 'rated above 3', user vectors being 1 and a sign of the group."""
    users = v.users.select("user_id", F.array(F.lit(1.0), F.when(F.col("sensitive"), 0.5).otherwise(-0.5)).alias("vector"))
    labels = v.train.select("user_id", "item_id", (F.col("rating") > 3).cast("int").alias("label"))
    items = labels.select("item_id").distinct().withColumn("vector", F.array(F.lit(0.2), F.lit(0.2)))
    out = M.logistic_half_step(labels, items, users, "item_id", "user_id", 2, 0.5)
    return out.select("item_id", *[r6(F.get("vector", F.lit(j)), f"v{j}") for j in range(2)])


@query("G8_implicit_half_step", sql(_LABELS + """, u AS (SELECT count(*) AS n, sum(x) AS x, sum(x * x) AS xx FROM (SELECT CASE WHEN sensitive THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS x FROM users)),
n AS (SELECT item_id, any_value(u.n) + 4 * count(*) + 0.5 AS a, any_value(u.x) + 4 * sum(r.x) AS b, any_value(u.xx) + 4 * sum(r.x * r.x) + 0.5 AS d, 5 * count(*) AS y, 5 * sum(r.x) AS yx FROM r, u GROUP BY 1)
SELECT item_id, round((y * d - b * yx) / (a * d - b * b), 6) AS v0, round((a * yx - b * y) / (a * d - b * b), 6) AS v1 FROM n"""))
def implicit_half_step(v: Views):
    """Item vectors over all pairs of users and items, of which only the interactions are read."""
    users = v.users.select("user_id", F.array(F.lit(1.0), F.when(F.col("sensitive"), 0.5).otherwise(-0.5)).alias("vector"))
    out = M.implicit_half_step(v.train.select("user_id", "item_id"), users, "item_id", "user_id", 2, 0.5, 4.0)
    return out.select("item_id", *[r6(F.get("vector", F.lit(j)), f"v{j}") for j in range(2)])


# Models by group, topics with a sensitive parent, folds

@query("G5_least_squares_by_group", sql("""+ s AS (SELECT sensitive, item_id, count(*) + 0.5 AS n, sum(age / 50.0::DOUBLE) AS a, sum(pow(age / 50.0::DOUBLE, 2)) + 0.5 AS aa, sum(rating) AS r, sum(rating * age / 50.0::DOUBLE) AS ra FROM train JOIN users USING (user_id) GROUP BY 1, 2)
SELECT sensitive, item_id, round((r * aa - a * ra) / (n * aa - a * a), 6) AS v0, round((n * ra - a * r) / (n * aa - a * a), 6) AS v1 FROM s"""))
def least_squares_by_group(v: Views):
    """Item vectors of one model for each group, all in one plan: a group and item make one key."""
    users = v.users.select("user_id", F.array(F.lit(1.0), (F.col("age") / 50).cast("double")).alias("vector"))
    rows = v.train.join(v.users.select("user_id", "sensitive"), "user_id").withColumn("key", F.struct("sensitive", "item_id"))
    out = G.als_step(rows, users, "key", "user_id", 2, 0.5)
    return out.select("key.sensitive", "key.item_id", *[r6(F.get("vector", F.lit(j)), f"v{j}") for j in range(2)])


@query("G9_sensitive_topic_step", sql("""+ ev AS MATERIALIZED (SELECT user_id, item_id, u.sensitive FROM train JOIN users u USING (user_id)), z AS (SELECT unnest([0, 1])::INT AS z),
ut AS (SELECT user_id, z, (1 + (user_id + z) % 2) / 3.0::DOUBLE AS p FROM (SELECT DISTINCT user_id FROM ev), z), it AS (SELECT sensitive, item_id, z, (1 + (item_id + z) % 3) / 100.0::DOUBLE AS q FROM (SELECT DISTINCT sensitive, item_id FROM ev), z),
w AS (SELECT user_id, item_id, ev.sensitive, z, p * q / sum(p * q) OVER (PARTITION BY user_id, item_id) AS m FROM ev JOIN ut USING (user_id) JOIN it USING (sensitive, item_id, z))
SELECT sensitive, item_id, z, round(sum(m) / sum(sum(m)) OVER (PARTITION BY sensitive, z) + 1e-9, 6) AS q FROM w GROUP BY 1, 2, 3"""))
def sensitive_topic_step(v: Views):
    """One EM step of P(item | topic, group): the group is a parent of the item that is always observed."""
    events = v.train.select("user_id", "item_id", F.lit(1.0).alias("n")).join(v.users.select("user_id", "sensitive"), "user_id")
    z = F.explode(F.array(F.lit(0), F.lit(1))).alias("z")
    users = events.select("user_id").distinct().select("user_id", z).withColumn("p", (1 + (F.col("user_id") + F.col("z")) % 2) / 3.0)
    items = events.select("sensitive", "item_id").distinct().select("sensitive", "item_id", z).withColumn("q", (1 + (F.col("item_id") + F.col("z")) % 3) / 100.0)
    return X.plsa_step(events, users, items, parents=("sensitive",))[1].withColumn("q", F.round(F.col("q") + 1e-9, 6))


_FOLDS = """+ r AS MATERIALIZED (SELECT user_id, item_id, rating, sensitive, (user_id * 7919 + item_id * 104729) % 1000003 % 5 AS own FROM interactions JOIN users USING (user_id)),
t AS MATERIALIZED (SELECT f AS fold, r.* FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS f) WHERE own <> f), m AS MATERIALIZED (SELECT fold, avg(rating) AS mu FROM t GROUP BY 1),
bi AS MATERIALIZED (SELECT fold, item_id, avg(rating - mu) AS bi FROM t JOIN m USING (fold) GROUP BY 1, 2), bu AS MATERIALIZED (SELECT fold, user_id, avg(rating - mu) AS bu FROM t JOIN m USING (fold) GROUP BY 1, 2),
held AS MATERIALIZED (SELECT own AS fold, r.user_id, r.item_id, rating, sensitive, mu + coalesce(bi, 0) + coalesce(bu, 0) AS score FROM r JOIN m ON m.fold = own LEFT JOIN bi ON bi.fold = own AND bi.item_id = r.item_id LEFT JOIN bu ON bu.fold = own AND bu.user_id = r.user_id),
seen AS MATERIALIZED (SELECT t.fold, t.item_id, sensitive, rating, mu + bi + bu AS score FROM t JOIN m USING (fold) JOIN bi ON bi.fold = t.fold AND bi.item_id = t.item_id JOIN bu ON bu.fold = t.fold AND bu.user_id = t.user_id),
gap AS (SELECT fold, avg(score) FILTER (sensitive) - avg(score) FILTER (NOT sensitive) AS gap FROM seen GROUP BY 1),
moves AS (SELECT fold, item_id, avg(rating - score) FILTER (sensitive) AS a1, avg(rating - score) FILTER (NOT sensitive) AS a2 FROM seen GROUP BY 1, 2),
adjusted AS MATERIALIZED (SELECT h.fold, h.rating, h.sensitive, unnest(['none', 'value', 'parity', 'parity_half']) AS adjustment,
    unnest([score, score + CASE WHEN a1 IS NULL OR a2 IS NULL THEN 0 WHEN sensitive THEN a1 ELSE a2 END, score - CASE WHEN sensitive THEN gap ELSE 0 END, score - CASE WHEN sensitive THEN gap ELSE -gap END / 2]) AS score
    FROM held h JOIN gap g ON g.fold = h.fold LEFT JOIN moves a ON a.fold = h.fold AND a.item_id = h.item_id)"""


@query("G3_G31_fold_report", sql(_FOLDS + """ SELECT fold::BIGINT AS fold, adjustment, count(*)::BIGINT AS n, round(sqrt(avg(pow(score - rating, 2))), 6) AS rmse, round(avg(abs(score - rating)), 6) AS mae,
round(avg(score) FILTER (sensitive) - avg(score) FILTER (NOT sensitive), 6) AS difference FROM adjusted GROUP BY 1, 2"""))
def fold_report(v: Views):
    """Fit, predict, adjust and report for five folds at once: a row trains in the four folds that don't hold it."""
    from evenkeel.plans import folds as O

    rows = v.rated.join(v.users.select("user_id", "sensitive"), "user_id")
    own = (F.col("user_id") * 7919 + F.col("item_id") * 104729) % 1000003 % 5
    report = O.fold_report(rows.withColumn("fold", own), 5)
    return report.select("fold", "adjustment", "n", r6("rmse"), r6("mae"), r6("difference"))


# Neighbours of users, features one by one, sentences, inference

_USERS = """+ r AS MATERIALIZED (SELECT user_id, item_id, rating FROM train), norms AS MATERIALIZED (SELECT user_id, sqrt(sum(rating * rating)) AS norm, avg(rating) AS mean FROM r GROUP BY 1),
unit AS MATERIALIZED (SELECT r.user_id, item_id, rating / norm AS w FROM r JOIN norms USING (user_id)),
sim AS MATERIALIZED (SELECT a.user_id, b.user_id AS other_id, round(sum(a.w * b.w), 6) AS similarity FROM unit a JOIN unit b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, other_id)::INT AS rank FROM sim) WHERE rank <= 30)"""


@query("G23_user_neighbours", sql(_USERS + " SELECT user_id, other_id, similarity, rank FROM near"))
def user_neighbours(v: Views):
    return G.user_neighbours(v.train, 30)


@query("G23_user_knn_scores", sql(_USERS + """, off AS MATERIALIZED (SELECT user_id AS other_id, item_id, rating - mean AS off FROM r JOIN norms USING (user_id))
SELECT t.user_id, t.item_id, round(any_value(m.mean) + sum(similarity * o.off) / sum(abs(similarity)), 4) AS score FROM test t JOIN near n ON n.user_id = t.user_id JOIN off o ON o.other_id = n.other_id AND o.item_id = t.item_id JOIN norms m ON m.user_id = t.user_id GROUP BY 1, 2"""))
def user_knn_scores(v: Views):
    train = v.train
    return G.user_knn_scores(train, v.test.select("user_id", "item_id"), G.user_neighbours(train, 30)).withColumn("score", F.round("score", 4))


@query("G23_feature_step", sql("""+ r AS MATERIALIZED (SELECT user_id, item_id, rating FROM train), m AS (SELECT avg(rating) AS mu FROM r), bi AS (SELECT item_id, avg(rating - mu) AS bi FROM r, m GROUP BY 1), bu AS (SELECT user_id, avg(rating - mu) AS bu FROM r, m GROUP BY 1),
e AS MATERIALIZED (SELECT user_id, item_id, rating - round(mu + bi + bu, 6) AS e, 0.1 + (user_id * 7919) % 1009 / 1009.0::DOUBLE AS x FROM r JOIN bi USING (item_id) JOIN bu USING (user_id), m),
q AS MATERIALIZED (SELECT item_id, sum(e * x) / (sum(x * x) + 0.5) AS q FROM e GROUP BY 1)
SELECT user_id, round(sum(e * q) / (sum(q * q) + 0.5), 6) AS x FROM e JOIN q USING (item_id) GROUP BY 1"""))
def feature_step(v: Views):
    """The first feature of the users after one turn: items from the users' start, users from the items."""
    users, _, _ = G.fit_features(v.train, 1, 0.5, rounds=1)
    return users.select("user_id", r6(F.get("values", F.lit(0)), "x"))


_DRAW = "((({s} * 7919 + {a} * 104729 + {b} * 1299709 + {c} * 15485863) % 1000003) * 48271) % 1000003"


def _draw(a, b, c) -> str:
    return _DRAW.format(s="o_orderkey", a=a, b=b, c=c)


@query("G30_G33_made_sentences", f"""WITH s AS (SELECT o_orderkey, list_transform(range(0, 1 + {_draw(70, 70, 4)} % 3), lambda c: list_transform(range(0, 1 + {_draw("c", 50, 3)} % 3),
    lambda j: CASE WHEN {_draw("c", "j", 2)} % 2 = 0 THEN {_draw("c", "j", 1)} % 20 ELSE -({_draw("c", "j", 1)} % 20) - 1 END)) AS clauses FROM orders)
SELECT o_orderkey AS sentence_id, array_to_string(list_transform(clauses, lambda c: array_to_string(list_transform(c, lambda x: CASE WHEN x < 0 THEN '~' || (-x - 1)::VARCHAR ELSE x::VARCHAR END), '^')), 'v') AS sentence,
       len(list_filter(clauses, lambda c: len(list_filter(c, lambda x: (CASE WHEN x < 0 THEN -x - 1 ELSE x END * 7 % 3 = 0) = (x < 0))) = 0)) > 0 AS truth FROM s""")
def made_sentences(v: Views):
    """A sentence for each order, true or not where the variables v with 7 v % 3 = 0 hold."""
    from evenkeel.plans import sentences as S

    rows = S.made_sentences(v.table("orders").select(F.col("o_orderkey").alias("sentence_id")), "sentence_id")
    true = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda x: x * 7 % 3 == 0)
    return rows.select("sentence_id", S.sentence_text(F.col("clauses")).alias("sentence"), S.holds(F.col("clauses"), true).alias("truth"))


def _vectors(v: Views):
    return v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 2).cast("int").alias("y"))


@query("M36_trained_inference")
def trained_inference(v: Views):
    """How well a classifier of whole embeddings tells the attribute of rows that it wasn't trained on; tests compare it with NumPy."""
    from evenkeel.plans import inference as I
    from evenkeel.plans import ranking as R

    rows = _vectors(v)
    held = F.pmod(F.col("vec_id"), F.lit(4)) == 2
    scored = I.inferred(rows.where(held), I.fit_classifier(rows.where(~held)))
    return R.auc(scored, "s", "y").select(r6(F.greatest(F.col("auc"), 1 - F.col("auc")), "auc"))


@query("M36_inference_gradient", """WITH e AS (SELECT (label % 2) - 0.5::DOUBLE AS off, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS place FROM embeddings WHERE vec_id % 4 <> 2)
SELECT place::INT AS place, round(sum(off * x), 5) AS slope FROM e GROUP BY 1 UNION ALL SELECT 0, round(sum((label % 2) - 0.5::DOUBLE), 5) FROM embeddings WHERE vec_id % 4 <> 2""")
def inference_gradient(v: Views):
    """The slope of the log-likelihood at zero, by weight."""
    import numpy as np

    from evenkeel.plans import inference as I

    rows = _vectors(v).where(F.pmod(F.col("vec_id"), F.lit(4)) != 2)
    slopes = I._sums(rows, np.zeros(65))[:65]
    return v.spark.createDataFrame([(i, float(s)) for i, s in enumerate(slopes)], "place int, slope double").withColumn("slope", F.round("slope", 5))
