"""Per-user ranking metrics from one ranked table.

Predictions are ranked once for each user; hits come from a join with the test items. One
aggregation then gives the raw counts of every cutoff, and each metric is an expression over them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTOFFS = (1, 5, 10, 50, 100)


def ranked(predictions: DataFrame, train: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Adds ``rank`` by score, ties by item; NaN scores count as missing, and train items are left out.

    With ``most`` only so many ranks come back, which limits what each task hands on.
    """
    rows = predictions.where(F.col("score").isNotNull() & ~F.isnan("score"))
    if train is not None:
        rows = rows.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")))
    return rows if most is None else rows.where(F.col("rank") <= most)


def with_hits(top: DataFrame, test: DataFrame) -> DataFrame:
    """Adds ``hit`` (0 or 1): whether the item is one of the user's test items."""
    wanted = test.select("user_id", "item_id", F.lit(1).alias("hit")).distinct()
    return top.join(wanted, ["user_id", "item_id"], "left").fillna({"hit": 0})


def user_counts(hits: DataFrame, users: DataFrame, train: DataFrame, test: DataFrame, n_items: DataFrame | int, cutoffs: tuple[int, ...] = (10,)) -> DataFrame:
    """One row for each user and cutoff ``k`` with what the metrics need.

    ``tp`` hits in the top k; ``gain`` and ``reciprocal`` the sums of 1/log2(rank + 1) and 1/rank over
    the hits; ``n_train`` and ``n_test``. ``n_items`` is a number or a table of one row. Users of ``users`` without predictions have zeros.
    """
    per = []
    for k in cutoffs:
        hit = (F.col("rank") <= k) & (F.col("hit") == 1)
        per.append(F.struct(F.lit(k).alias("k"), F.sum(F.when(hit, 1).otherwise(0)).alias("tp"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"), F.sum(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias("reciprocal"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("n_top")).alias(f"at_{k}"))
    counted = hits.groupBy("user_id").agg(*per)
    base = users.select("user_id").join(counted, "user_id", "left")
    base = base.join(train.groupBy("user_id").agg(F.count("*").alias("n_train")), "user_id", "left").join(test.groupBy("user_id").agg(F.count("*").alias("n_test")), "user_id", "left")
    zero = [F.coalesce(F.col(f"at_{k}"), F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("reciprocal"), F.lit(0).cast("long").alias("n_top"))) for k in cutoffs]
    wide = base.select("user_id", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test"), F.inline(F.array(*zero)))
    if isinstance(n_items, DataFrame):
        return wide.join(F.broadcast(n_items.toDF("n_items")), F.lit(True))
    return wide.withColumn("n_items", F.lit(n_items).cast("long"))


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(empty)


def _c(name: str) -> Column:
    return F.col(name)


def _ideal_gain(n: Column, most: int) -> Column:
    """Sum of the first ``n`` discounts, for n up to ``most``: a table of constants."""
    sums, total = [0.0], 0.0
    for i in range(1, most + 1):
        total += 1 / math.log2(i + 1)
        sums.append(total)
    return F.element_at(F.array(*[F.lit(s) for s in sums]), (n + 1).cast("int"))


#: Metric -> expression over the columns of ``user_counts``.
METRICS: dict[str, Callable[[int], Column]] = {
    "tp": lambda k: _c("tp").cast("double"),
    "fp": lambda k: (k - _c("tp")).cast("double"),
    "fn": lambda k: (_c("n_test") - _c("tp")).cast("double"),
    "tn": lambda k: (_c("n_items") - _c("n_train") - _c("n_test") - (k - _c("tp"))).cast("double"),
    "precision": lambda k: _c("tp") / k,
    "recall": lambda k: _ratio(_c("tp"), _c("n_test"), 1.0),
    "f1_score": lambda k: _ratio(2 * (_c("tp") / k) * _ratio(_c("tp"), _c("n_test"), 1.0), _c("tp") / k + _ratio(_c("tp"), _c("n_test"), 1.0)),
    "tpr": lambda k: F.round(_ratio(_c("tp"), _c("n_test")), 4),
    "tnr": lambda k: F.round(_ratio(_c("n_items") - _c("n_train") - _c("n_test") - (k - _c("tp")), _c("n_items") - _c("n_train") - _c("n_test")), 4),
    "fpr": lambda k: 1 - METRICS["tnr"](k),
    "fnr": lambda k: 1 - METRICS["tpr"](k),
    "predicted_positive": lambda k: F.lit(float(k)),
    "mrr": lambda k: _c("reciprocal") / k,
    "ndcg": lambda k: _ratio(_c("gain"), _ideal_gain(F.least(_c("n_test"), F.lit(k)), k)),
    "ndcg_retrieved": lambda k: _ratio(_c("gain"), _ideal_gain(_c("tp"), k)),
    "hit": lambda k: F.when(_c("tp") > 0, 1.0).otherwise(0.0),
}


def user_metrics(counts: DataFrame, names: list[str], cutoffs: tuple[int, ...]) -> DataFrame:
    """The long table (metric, k, user_id, value) of the chosen metrics."""
    out = None
    for k in cutoffs:
        values = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), METRICS[m](k).cast("double").alias("value")) for m in names]))
        part = counts.where(F.col("k") == k).select("user_id", F.lit(k).alias("k"), values)
        out = part if out is None else out.union(part)
    return out.select("metric", "k", "user_id", "value")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over users with a finite value, rounded to 4 places."""
    finite = metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return finite.groupBy("metric", "k").agg(F.round(F.avg("value"), 4).alias("value"))


def group_means(metrics: DataFrame, users: DataFrame) -> DataFrame:
    """Means in all users and in each sensitive group, and their difference: rounded before subtracting."""
    rows = metrics.where(F.col("value").isNotNull() & ~F.isnan("value")).join(users.select("user_id", "sensitive"), "user_id")
    means = rows.groupBy("metric", "k").agg(
        F.round(F.avg("value"), 4).alias("total"),
        F.round(F.avg(F.when(F.col("sensitive"), F.col("value"))), 4).alias("g1"),
        F.round(F.avg(F.when(~F.col("sensitive"), F.col("value"))), 4).alias("g2"),
    )
    return means.withColumn("diff", F.round(F.col("g1") - F.col("g2"), 4))


def tie_averaged_ndcg(hits: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Per-user nDCG whose gains are averaged inside ties of the score, so the order of ties doesn't matter."""
    top = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ties = hits.groupBy("user_id", "score").agg((F.avg("hit") * F.sum(top)).alias("gain"))
    return _ndcg_of_ties(ties, test, k)


def tie_averaged_of_top(top: DataFrame, tied: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """``tie_averaged_ndcg`` of the ranks up to ``k`` and all hits, in whatever place. ``tied`` has for each user's last score of these how many scores there are of it (user_id, score, tied)."""
    discount = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ties = top.groupBy("user_id", "score").agg(F.sum("hit").alias("_hits"), F.count("*").alias("_n"), F.sum(discount).alias("_sum"), F.min("rank").alias("_first"))
    ties = ties.where(F.col("_first") <= k).join(tied, ["user_id", "score"], "left")
    return _ndcg_of_ties(ties.withColumn("gain", F.col("_hits") / F.coalesce("tied", "_n") * F.col("_sum")), test, k)


def _ndcg_of_ties(ties: DataFrame, test: DataFrame, k: int) -> DataFrame:
    gains = ties.groupBy("user_id").agg(F.sum("gain").alias("gain"))
    sizes = test.groupBy("user_id").agg(F.count("*").alias("n_test"))
    return sizes.join(gains, "user_id", "left").select("user_id", _ratio(F.coalesce("gain", F.lit(0.0)), _ideal_gain(F.least("n_test", F.lit(k)), k)).alias("ndcg"))


def popularity(train: DataFrame) -> DataFrame:
    """Train counts of items."""
    return train.groupBy("item_id").agg(F.count("*").alias("n"))


def mean_popularity(top: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """Per user the mean train count of the top k items."""
    rows = top.where(F.col("rank") <= k).join(popularity(train), "item_id", "left").fillna({"n": 0})
    return rows.groupBy("user_id").agg(F.avg("n").alias("value"))


def novelty(top: DataFrame, train: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Per user the sum over the top k of 1 - n/users, divided by k."""
    total = users.agg(F.count("*").alias("users"))
    rows = top.where(F.col("rank") <= k).join(popularity(train), "item_id", "left").fillna({"n": 0}).join(F.broadcast(total), F.lit(True)).withColumn("share", 1 - F.col("n") / F.col("users"))
    return rows.groupBy("user_id").agg((F.sum("share") / k).alias("value"))


def item_coverage(top: DataFrame, n_items: DataFrame, k: int) -> DataFrame:
    """Share of the items that are in any user's top k, rounded to 2 places."""
    found = top.where(F.col("rank") <= k).agg(F.countDistinct("item_id").alias("found"))
    return found.join(F.broadcast(n_items), F.lit(True)).select(F.round(F.col("found") / F.col("n_items"), 2).alias("item_coverage"))


def item_hits(hits: DataFrame, k: int) -> DataFrame:
    """Hits of each item in the top k."""
    return hits.where((F.col("rank") <= k) & (F.col("hit") == 1)).groupBy("item_id").agg(F.count("*").alias("hits"))


def list_metrics(lists: DataFrame, key: str, position: str, relevance: str) -> DataFrame:
    """Standard list metrics of graded lists: first-hit reciprocal rank, R-precision, average precision and two DCG discounts."""
    w = Window.partitionBy(key).orderBy(position)
    rel = (F.col(relevance) > 0).cast("int")
    rows = lists.withColumns({"_i": F.row_number().over(w), "_hits": F.sum(rel).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(rel).over(Window.partitionBy(key)), "_best": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(relevance), position))})
    plain = F.when(F.col("_i") <= 2, 1.0).otherwise(1 / F.log2(F.col("_i")))
    plain_best = F.when(F.col("_best") <= 2, 1.0).otherwise(1 / F.log2(F.col("_best")))
    return rows.groupBy(key).agg(
        F.coalesce(1 / F.min(F.when(rel == 1, F.col("_i"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when((F.col("_i") <= F.col("_all")), rel)), F.lit(0.0)).alias("r_precision"),
        F.coalesce(F.avg(F.when(rel == 1, F.col("_hits") / F.col("_i"))), F.lit(0.0)).alias("average_precision"),
        F.sum(F.col(relevance) * plain).alias("dcg0"),
        F.sum(F.col(relevance) / F.log2(F.col("_i") + 1)).alias("dcg1"),
        F.sum(F.col(relevance) * plain_best).alias("ideal0"),
    ).withColumn("ndcg0", _ratio(F.col("dcg0"), F.col("ideal0")))


def auc(rows: DataFrame, score: str, label: str, *groups: str) -> DataFrame:
    """Area under the ROC curve from midranks, per group; null with one class only.

    Scores are aggregated to their distinct values first, so windows run over those.
    """
    counts = rows.groupBy(*groups, score).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("_q"))
    w = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("_below", F.coalesce(F.sum("_q").over(w), F.lit(0)))
    total = below.groupBy(*groups).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)).alias("_u"), F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    return total.select(*groups, F.when((F.col("_np") > 0) & (F.col("_nq") > 0), F.col("_u") / (F.col("_np") * F.col("_nq"))).alias("auc"))
