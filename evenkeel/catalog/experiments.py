"""Experiments: reports over folds and groups, model losses, plot data and further splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.operators import prepare as T
from evenkeel.operators import sampling as N
from evenkeel.operators import split as P
from evenkeel.operators.numbering import kept
from evenkeel.plans import factors as X
from evenkeel.plans import fairness as F_
from evenkeel.plans import models as G
from evenkeel.plans import ranking as R
from evenkeel.sources.views import Views

from .registry import query, r6
from .views_sql import PREDICTIONS, RANKED, SCORED, negatives_sql, sql

_HASH = "((user_id * 7919 + item_id * 104729) % 1000003)"


@query("P7_user_80_20_split", sql("SELECT user_id, item_id, CASE WHEN rn <= n - floor(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM numbered"))
def split_80_20(v: Views):
    return P.per_user_timestamp_split(v.interactions, "user_id", ["ts", "item_id"], 0.0, 0.2).select("user_id", "item_id", "part")


@query("P11_random_split_truncated", sql(f"+ p AS (SELECT user_id, item_id, row_number() OVER (ORDER BY floor({_HASH} * 64 / 1000003), {_HASH}, user_id, item_id) - 1 AS i, count(*) OVER () AS n FROM interactions) SELECT user_id, item_id, CASE WHEN i < floor(n * 0.1::DOUBLE) THEN 'val' WHEN i < 2 * floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM p"))
def split_truncated(v: Views):
    rows = v.interactions
    n = rows.count()  # the sizes of the parts are counts of rows
    part = int(n * 0.1)
    i = F.col("position")
    return P.positions(rows, ["user_id", "item_id"], ranges=P.ranges_for(n)).select("user_id", "item_id", F.when(i < part, "val").when(i < 2 * part, "test").otherwise("train").alias("part"))


@query("P15_train_without_held", sql("SELECT i.user_id, i.item_id FROM interactions i ANTI JOIN test t ON i.user_id = t.user_id AND i.item_id = t.item_id"))
def without_held(v: Views):
    return v.rated.join(v.test, ["user_id", "item_id"], "left_anti").select("user_id", "item_id")


@query("P23_evaluation_negatives", sql(negatives_sql("test", "interactions", 5) + " SELECT user_id, item_id, negative_id FROM negatives"))
def evaluation_negatives(v: Views):
    """Up to five items for each test row that the user has met in no part."""
    return N.negatives(v.test, v.rated, v.rated, 5)


@query("P23_evaluation_negatives_known", "SELECT 0::BIGINT AS known")
def evaluation_negatives_known(v: Views):
    drawn = N.negatives(v.test, v.rated, v.rated, 5)
    return drawn.join(v.rated.select("user_id", F.col("item_id").alias("negative_id")), ["user_id", "negative_id"], "left_semi").agg(F.count("*").alias("known"))


@query("K8_block_ids", sql("SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS u, dense_rank() OVER (ORDER BY item_id) - 1 AS i, rating FROM train"))
def block_ids(v: Views):
    rows = T.dense_ids(T.dense_ids(v.train, "user_id", "u"), "item_id", "i")
    return rows.select(F.col("u").cast("long").alias("u"), F.col("i").cast("long").alias("i"), "rating")


@query("M29_group_score_report", sql("SELECT gender, count(*)::BIGINT AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS low, round(max(score), 6) AS high, (count(*) FILTER (score > 3))::BIGINT AS above FROM scored GROUP BY 1", SCORED))
def group_report(v: Views):
    from evenkeel.plans.pair_sums import histogram, moments

    # Scores have 6 places: above 3 begins a millionth higher.
    sums = kept(v.score_sums(v.users, F.col("gender") == "M", edges=(3.000001,)))
    above = histogram(sums, "grp").where("bin = 1").select("grp", F.col("n").alias("above"))
    rows = moments(sums, "grp").join(above, "grp", "left").fillna({"above": 0})
    return rows.select(F.when(F.col("grp") == 1, "M").otherwise("F").alias("gender"), "n", r6("mean"), r6(F.sqrt("var"), "sd"), r6("low"), r6("high"), "above")


@query("M30_G31_fold_means", sql("""+ f AS (SELECT user_id, rating, (rn - 1) % 5 AS fold FROM numbered), g AS (SELECT fold, avg(rating) AS mean, stddev_pop(rating) AS sd FROM f GROUP BY 1)
SELECT 'mean' AS metric, round(avg(mean), 6) AS value FROM g UNION ALL SELECT 'sd', round(avg(sd), 6) FROM g"""))
def fold_means(v: Views):
    folds = P.interlaced_k_fold(v.interactions, "user_id", ["ts", "item_id"], 5).groupBy("fold").agg(F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("sd"))
    return folds.unpivot(["fold"], ["mean", "sd"], "metric", "value").groupBy("metric").agg(r6(F.avg("value"), "value"))


@query("M34_list_sizes", sql("""SELECT size::INT AS size, count(DISTINCT user_id)::BIGINT AS users, round(sum(hit) / count(DISTINCT user_id), 6) AS hits_per_user FROM ranked, (SELECT unnest([1, 10, 100]) AS size) WHERE rank <= size GROUP BY 1""", RANKED))
def list_sizes(v: Views):
    hits = R.ranked(v.shortlist(100), most=100)
    sized = hits.withColumn("size", F.explode(F.filter(F.array(F.lit(1), F.lit(10), F.lit(100)), lambda s: s >= F.col("rank"))))
    return sized.groupBy("size").agg(F.countDistinct("user_id").alias("users"), r6(F.sum("hit") / F.countDistinct("user_id"), "hits_per_user"))


@query("M36_inference_auc", """WITH x AS (SELECT embedding[1]::DOUBLE AS s, (label % 2)::INT AS y FROM embeddings), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS mid FROM x),
a AS (SELECT (sum(mid) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM r) SELECT round(greatest(auc, 1 - auc), 6) AS auc FROM a""")
def inference_auc(v: Views):
    """How well a score tells the attribute, whichever way round."""
    rows = v.table("embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("s"), (F.col("label") % 2).alias("y"))
    return R.auc(rows, "s", "y").select(r6(F.greatest(F.col("auc"), 1 - F.col("auc")), "auc"))


@query("R7_plot_data", sql("SELECT gender, floor(score / 0.25) * 0.25 AS bin, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY gender), 6) AS density FROM scored GROUP BY 1, 2", SCORED))
def plot_data(v: Views):
    """Histogram and density of the scores by group."""
    from evenkeel.plans.pair_sums import histogram

    # Biases lie within 4 of a mean from 1 to 5.
    counts = histogram(v.score_sums(v.users, F.col("gender") == "M", edges=tuple(i / 4 for i in range(-28, 53))), "grp")
    counts = counts.select(F.when(F.col("grp") == 1, "M").otherwise("F").alias("gender"), ((F.col("bin") - 29) * 0.25).cast("double").alias("bin"), "n")
    return counts.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gender")), 6))


@query("R8_model_names", "SELECT DISTINCT split_part(p_type, ' ', 1) AS model, lower(replace(p_brand, '#', '_')) AS path FROM part")
def model_names(v: Views):
    return v.table("part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("model"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("path")).distinct()


@query("G5_models_by_group", sql("""+ g AS MATERIALIZED (SELECT t.*, u.sensitive FROM train t JOIN users u USING (user_id)), m AS MATERIALIZED (SELECT sensitive, avg(rating) AS mu FROM g GROUP BY 1),
b AS MATERIALIZED (SELECT concat(sensitive, ':', item_id) AS cell, avg(rating - mu) AS bi FROM g JOIN m USING (sensitive) GROUP BY 1),
asked AS MATERIALIZED (SELECT t.user_id, t.item_id, concat(u.sensitive, ':', t.item_id) AS cell, mu FROM test t JOIN users u USING (user_id) JOIN m ON m.sensitive = u.sensitive)
SELECT user_id, item_id, round(mu + coalesce(bi, 0), 6) AS score FROM asked LEFT JOIN b USING (cell)"""))
def by_group(v: Views):
    """One item-bias model for each sensitive value, all fitted in one plan."""
    train, users = v.train.join(v.users.select("user_id", "sensitive"), "user_id"), v.users.select("user_id", "sensitive")
    means = train.groupBy("sensitive").agg(F.avg("rating").alias("mu"))
    items = train.join(F.broadcast(means), "sensitive").groupBy("sensitive", "item_id").agg(F.avg(F.col("rating") - F.col("mu")).alias("bi"))
    rows = v.test.join(users, "user_id").join(F.broadcast(means), "sensitive").join(items, ["sensitive", "item_id"], "left")
    return rows.select("user_id", "item_id", r6(F.col("mu") + F.coalesce("bi", F.lit(0.0)), "score"))


_FACTORS = """+ p AS (SELECT user_id, 0.1 * (user_id % 3) AS bu, 0.01 * (user_id % 7) AS p1, 0.02 * (user_id % 5) AS p2 FROM users), q AS (SELECT item_id, 0.1 * (item_id % 4) AS bi, 0.03 * (item_id % 6) AS q1, 0.01 * (item_id % 8) AS q2 FROM items)"""


def _factors(v: Views):
    u, i = F.col("user_id"), F.col("item_id")
    users = v.users.select("user_id", (0.1 * (u % 3)).alias("bu"), F.array(0.01 * (u % 7), 0.02 * (u % 5)).alias("p"))
    items = v.items.select("item_id", (0.1 * (i % 4)).alias("bi"), F.array(0.03 * (i % 6), 0.01 * (i % 8)).alias("q"))
    return users, items


@query("G6_G28_factor_scores", sql(_FACTORS + " SELECT user_id, item_id, round((2.5 + bu + bi + p1 * q1 + p2 * q2)::DOUBLE, 6) AS score FROM test JOIN p USING (user_id) JOIN q USING (item_id)"))
def factor_scores(v: Views):
    users, items = _factors(v)
    return X.factor_scores(v.test.select("user_id", "item_id"), users, items, 2.5).withColumn("score", F.round("score", 6))


@query("G6_factor_loss", sql(_FACTORS + """, e AS (SELECT sum(pow(2.5 + bu + bi + p1 * q1 + p2 * q2 - rating, 2)) AS e FROM train JOIN p USING (user_id) JOIN q USING (item_id))
SELECT round(0.5 * e + 0.5 * 0.1 * ((SELECT sum(bu * bu + p1 * p1 + p2 * p2) FROM p) + (SELECT sum(bi * bi + q1 * q1 + q2 * q2) FROM q)), 4)::DOUBLE AS loss FROM e"""))
def factor_loss(v: Views):
    users, items = _factors(v)
    return X.factor_loss(v.train, users, items, 2.5, 0.1).select(F.round("loss", 4).alias("loss"))


@query("G9_topic_step", sql("""+ ev AS (SELECT user_id, item_id, 1.0::DOUBLE AS n FROM train), z AS (SELECT unnest([0, 1])::INT AS z),
ut AS (SELECT user_id, z, (1 + (user_id + z) % 2) / 3.0::DOUBLE AS p FROM (SELECT DISTINCT user_id FROM ev), z), it AS (SELECT item_id, z, (1 + (item_id + z) % 3) / 100.0::DOUBLE AS q FROM (SELECT DISTINCT item_id FROM ev), z),
w AS (SELECT user_id, item_id, z, n * p * q / sum(p * q) OVER (PARTITION BY user_id, item_id) AS m FROM ev JOIN ut USING (user_id) JOIN it USING (item_id, z))
SELECT user_id, z, round(sum(m) / sum(sum(m)) OVER (PARTITION BY user_id) + 1e-9, 6) AS p FROM w GROUP BY user_id, z"""))
def topic_step(v: Views):
    events = v.train.select("user_id", "item_id", F.lit(1.0).alias("n"))
    z = F.explode(F.array(F.lit(0), F.lit(1))).alias("z")
    users = events.select("user_id").distinct().select("user_id", z).withColumn("p", (1 + (F.col("user_id") + F.col("z")) % 2) / 3.0)
    items = events.select("item_id").distinct().select("item_id", z).withColumn("q", (1 + (F.col("item_id") + F.col("z")) % 3) / 100.0)
    return X.plsa_step(events, users, items)[0].withColumn("p", F.round(F.col("p") + 1e-9, 6))  # off the ties of rounding


@query("G13_projected_line_search", sql("""+ r AS (SELECT rating, rating - 3 AS slope FROM train), s AS (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS step)
SELECT step, round(avg(pow(greatest(least(3 + step * slope, 5), 0) - rating, 2)), 6) AS loss FROM r, s GROUP BY 1"""))
def projected(v: Views):
    rows = v.train.select("rating", F.lit(3.0).alias("start"), (F.col("rating") - 3).alias("slope"))
    return X.line_search(rows, "start", "slope", "rating", [0.0, 0.5, 1.0, 2.0], 0.0, 5.0).withColumn("loss", F.round("loss", 6))


@query("G14_added_users", sql("""+ fake AS (SELECT -1 - (item_id % 3) AS user_id, item_id, 5.0::DOUBLE AS rating FROM (SELECT DISTINCT item_id FROM train WHERE item_id % 10 = 0)), a AS (SELECT user_id, item_id, rating FROM train UNION ALL SELECT * FROM fake),
m AS (SELECT avg(rating) AS mu FROM a), bi AS (SELECT item_id, avg(rating - mu) AS bi FROM a, m GROUP BY 1), bu AS (SELECT user_id, avg(rating - mu) AS bu FROM a, m GROUP BY 1)
SELECT t.user_id, t.item_id, round(mu + coalesce(bi, 0) + coalesce(bu, 0), 6) AS score FROM test t LEFT JOIN bi USING (item_id) LEFT JOIN bu ON bu.user_id = t.user_id, m"""))
def added_users(v: Views):
    """Scores of the original users after made-up users are added and the model is fitted again."""
    train = v.train.select("user_id", "item_id", "rating")
    fake = train.where("item_id % 10 = 0").select("item_id").distinct().select((-1 - F.col("item_id") % 3).alias("user_id"), "item_id", F.lit(5.0).alias("rating"))
    return G.bias_scores(train.union(fake), v.test.select("user_id", "item_id"))


@query("M35_protected_precision", sql("SELECT gender, round(avg(tp / k::DOUBLE), 6) AS precision, round(avg(CASE WHEN n_test > 0 THEN gain / (SELECT best FROM ideal WHERE m = least(n_test, 10)) ELSE 0 END), 6) AS ndcg FROM counts JOIN users USING (user_id) WHERE k = 10 GROUP BY 1", RANKED))
def protected_precision(v: Views):
    counts = R.user_counts(R.ranked(v.shortlist(10), most=10), v.users, v.train, v.test, 0, (10,))
    rows = R.user_metrics(counts, ["precision", "ndcg"], (10,)).join(v.users, "user_id")
    return rows.groupBy("gender").agg(r6(F.avg(F.when(F.col("metric") == "precision", F.col("value"))), "precision"), r6(F.avg(F.when(F.col("metric") == "ndcg", F.col("value"))), "ndcg"))


@query("S30_stored_matrix", sql("SELECT user_id, item_id, score FROM predictions", PREDICTIONS))
def stored_matrix(v: Views):
    """The matrix of scores as rows (user, item, score), through its map form: missing cells stay missing."""
    rows = v.predictions.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "score"))).alias("cells"))
    return rows.select("user_id", F.explode("cells").alias("item_id", "score"))


@query("G11_fitted_errors", "SELECT true AS falls")
def fitted_errors(v: Views):
    """Alternating least squares until the error hardly sinks: whether it sank in every round."""
    errors = X.fit_als(v.train, 2, 0.5, rounds=4)[2]
    return v.spark.createDataFrame([(all(a >= b - 1e-9 for a, b in zip(errors, errors[1:])),)], "falls boolean")


@query("G9_fitted_likelihood", "SELECT true AS grows")
def fitted_likelihood(v: Views):
    """Topics by EM until the likelihood hardly grows: whether it grew in every round."""
    history = X.fit_plsa(v.train.select("user_id", "item_id", F.lit(1.0).alias("n")), 2, rounds=4)[2]
    return v.spark.createDataFrame([(all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:])),)], "grows boolean")


@query("G15_reranking_invariants", sql("SELECT 0::BIGINT AS wrong_sizes, true AS closer", PREDICTIONS))
def reranking_invariants(v: Views):
    """No user's list changes its length, and the groups are no further apart than without swaps."""
    rows = v.shortlist(20, v.users.select("user_id", "sensitive"), ties=(1, -1)).withColumnRenamed("hit", "label")
    swapped, plain = F_.fair_rerank(rows, 10, 0.0), F_.fair_rerank(rows, 10, float("inf"))

    def summary(lists, name):
        users = lists.groupBy("user_id", "sensitive").agg(F.count("*").alias(f"n_{name}"), F.sum("label").alias("hits"))
        gap = users.agg(F.abs(F.avg(F.when(F.col("sensitive"), F.col("hits"))) - F.avg(F.when(~F.col("sensitive"), F.col("hits")))).alias(f"gap_{name}"))
        return users.select("user_id", f"n_{name}"), gap

    (own, gap), (base, gap_base) = summary(swapped, "a"), summary(plain, "b")
    sizes = own.join(base, "user_id", "full").agg(F.sum(F.when(F.col("n_a").eqNullSafe(F.col("n_b")), 0).otherwise(1)).alias("wrong_sizes"))
    return sizes.join(gap, F.lit(True)).join(gap_base, F.lit(True)).select("wrong_sizes", (F.col("gap_a") <= F.col("gap_b") + 1e-9).alias("closer"))
