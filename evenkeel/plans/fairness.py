"""Group-fairness and rating-error measures over predictions with a binary sensitive attribute.

Inputs are long tables: ``scored`` has user_id, item_id, score, sensitive and, where truth is
needed, rating. Each function returns one row unless it says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.operators.numbering import kept, numbered
from evenkeel.plans.pair_sums import moments


def _g1(x: Column) -> Column:
    return F.when(F.col("sensitive"), x)


def _g2(x: Column) -> Column:
    return F.when(~F.col("sensitive"), x)


def user_errors(test: DataFrame, predictions: DataFrame, users: DataFrame) -> DataFrame:
    """Per-user rmse and mae over rated test items; 0 for users without any."""
    joined = test.join(predictions, ["user_id", "item_id"]).withColumn("e", F.col("score") - F.col("rating"))
    per = joined.groupBy("user_id").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))
    return users.select("user_id").join(per, "user_id", "left").fillna({"rmse": 0.0, "mae": 0.0})


def demographic_parity(counts: DataFrame, users: DataFrame) -> DataFrame:
    """|mean predicted positives of group 1 / its users - the same of group 2|, from ``user_counts``."""
    rows = counts.join(users.select("user_id", "sensitive"), "user_id")
    return rows.agg(F.abs(F.avg(_g1(F.col("n_top"))) / F.count(_g1(F.lit(1))) - F.avg(_g2(F.col("n_top"))) / F.count(_g2(F.lit(1)))).alias("value"))


def rating_demographic_parity(scored: DataFrame) -> DataFrame:
    """Mean over items of |mean score of group 1 - of group 2|; null if an item misses a group."""
    items = scored.groupBy("item_id").agg(F.abs(F.avg(_g1(F.col("score"))) - F.avg(_g2(F.col("score")))).alias("d"))
    return items.agg(F.when(F.count("d") == F.count("*"), F.avg("d")).alias("value"))


def item_parity(sums: DataFrame) -> DataFrame:
    """``rating_demographic_parity`` from ``pair_sums.item_sums`` with group 1 for the first."""
    items = moments(sums, "item_id", "grp").groupBy("item_id").agg(F.abs(F.avg(F.when(F.col("grp") == 1, F.col("mean"))) - F.avg(F.when(F.col("grp") == 0, F.col("mean")))).alias("d"))
    return items.agg(F.when(F.count("d") == F.count("*"), F.avg("d")).alias("value"))


def rating_equal_opportunity(scored: DataFrame) -> DataFrame:
    """The same of |score - rating|, where a missing group counts as 0."""
    e = F.abs(F.col("score") - F.col("rating"))
    items = scored.groupBy("item_id").agg(F.abs(F.coalesce(F.avg(_g1(e)), F.lit(0.0)) - F.coalesce(F.avg(_g2(e)), F.lit(0.0))).alias("d"))
    return items.agg(F.avg("d").alias("value"))


def mean_difference(scored: DataFrame) -> DataFrame:
    """|mean of all scores of group 1 - of group 2|."""
    return scored.agg(F.abs(F.avg(_g1(F.col("score"))) - F.avg(_g2(F.col("score")))).alias("value"))


def difference_of_means(sums: DataFrame) -> DataFrame:
    """``mean_difference`` from ``pair_sums.item_sums`` with group 1 for the first."""
    return moments(sums, "grp").agg(F.abs(F.max(F.when(F.col("grp") == 1, F.col("mean"))) - F.max(F.when(F.col("grp") == 0, F.col("mean")))).alias("value"))


def epsilon_fairness(scored: DataFrame, max_pairs: int = 5000, items: DataFrame | None = None, rows_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mean over item pairs of |P(first above second | group 1) - P(... | group 2)|.

    Pairs in the order of their items up to ``max_pairs`` that both groups score count: the bound is
    part of the measure. With the items sorted, the first pairs begin with the first item, then with the first few:
    users are joined for these, and for twice as many until the pairs suffice or no item is left.
    While it is one item, its partners too come from the first items, of which four times as many are tried next.
    ``items`` are the different items of ``scored``. ``rows_of`` gives the rows (item_id, score) of the users of a table
    with its columns; unless given it joins ``scored``.
    """
    items = kept(scored.select("item_id").distinct() if items is None else items.select("item_id"))
    n_items, n_first, n_second = items.count(), 1, 25 * max_pairs
    rows_of = rows_of or (lambda first: first.join(scored.select("user_id", "item_id", "score"), "user_id"))
    above = F.when(F.col("s1") > F.col("score"), 1.0).otherwise(0.0)

    def up_to(n: int) -> Column:
        if n >= n_items:
            return F.lit(True)
        return F.col("item_id") <= items.orderBy("item_id").limit(n).agg(F.max("item_id")).first()[0]

    while True:
        first = scored.where(up_to(n_first)).select("user_id", "sensitive", F.col("item_id").alias("i1"), F.col("score").alias("s1"))
        partners = rows_of(first).where(up_to(n_second if n_first == 1 else n_items) & (F.col("i1") < F.col("item_id")))
        pairs = partners.groupBy("i1", F.col("item_id").alias("i2")).agg(F.avg(_g1(above)).alias("p1"), F.avg(_g2(above)).alias("p2")).where("p1 is not null and p2 is not null")
        used = kept(pairs.orderBy("i1", "i2").limit(max_pairs))
        if used.count() >= max_pairs or (n_first >= n_items and (n_first > 1 or n_second >= n_items)):
            break
        if n_first == 1 and n_second < n_items:
            n_second *= 4
        else:
            n_first *= 2
    return used.agg(F.avg(F.abs(F.col("p1") - F.col("p2"))).alias("value"))


def item_group_means(scored: DataFrame) -> DataFrame:
    """Per item the mean scores (y1, y2) and ratings (r1, r2) of both groups."""
    return scored.groupBy("item_id").agg(F.avg(_g1(F.col("score"))).alias("y1"), F.avg(_g2(F.col("score"))).alias("y2"), F.avg(_g1(F.col("rating"))).alias("r1"), F.avg(_g2(F.col("rating"))).alias("r2"))


def _positive(x: Column) -> Column:
    """max(0, x) with 0 for missing values."""
    return F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))


def unfairness(scored: DataFrame, both_groups: bool = False) -> DataFrame:
    """Value, absolute, under- and overestimation unfairness and non-parity.

    Missing groups make the first two null for the item and count as 0 in the other two; with
    ``both_groups`` only items that both groups rate take part, and the ratio of the group means
    (``disparate``) is added.
    """
    items = item_group_means(scored)
    if both_groups:
        items = items.where("y1 is not null and y2 is not null")
    value = F.abs((F.col("y1") - F.col("r1")) - (F.col("y2") - F.col("r2")))
    absolute = F.abs(F.abs(F.col("y1") - F.col("r1")) - F.abs(F.col("y2") - F.col("r2")))
    under = F.abs(_positive(F.col("r1") - F.col("y1")) - _positive(F.col("r2") - F.col("y2")))
    over = F.abs(_positive(F.col("y1") - F.col("r1")) - _positive(F.col("y2") - F.col("r2")))
    out = items.agg(F.avg(value).alias("value"), F.avg(absolute).alias("absolute"), F.avg(under).alias("under"), F.avg(over).alias("over"))
    groups = scored.agg(F.avg(_g1(F.col("score"))).alias("m1"), F.avg(_g2(F.col("score"))).alias("m2"))
    out = out.join(F.broadcast(groups), F.lit(True)).withColumn("parity", F.abs(F.col("m1") - F.col("m2")))
    return (out.withColumn("disparate", F.col("m1") / F.col("m2")) if both_groups else out).drop("m1", "m2")


def equity_scores(hits: DataFrame, users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Per category the hits in the top k per user of group 1, divided by the same of group 2."""
    sizes = users.agg(F.count(_g1(F.lit(1))).alias("n1"), F.count(_g2(F.lit(1))).alias("n2"))
    rows = hits.where((F.col("rank") <= k) & (F.col("hit") == 1)).join(users, "user_id").join(items, "item_id")
    per = rows.groupBy("category").agg(F.count(_g1(F.lit(1))).alias("h1"), F.count(_g2(F.lit(1))).alias("h2")).join(F.broadcast(sizes), F.lit(True))
    return per.select("category", F.when(F.col("h2") > 0, (F.col("h1") / F.col("n1")) / (F.col("h2") / F.col("n2"))).alias("equity"))


def user_benefits(scored: DataFrame, users: DataFrame) -> DataFrame:
    """Per user 5 - mean |score - rating|, and 5 for users without test items."""
    per = scored.groupBy("user_id").agg((5 - F.avg(F.abs(F.col("score") - F.col("rating")))).alias("benefit"))
    return users.select("user_id", "sensitive").join(per, "user_id", "left").fillna({"benefit": 5.0})


def entropy_index(benefits: DataFrame, alpha: float) -> DataFrame:
    """Generalised entropy of the benefits, with its parts between and within the sensitive groups.

    ``total = between + within``: groups weigh by their share of users and their mean benefit.
    """
    b, mg, m = F.col("benefit"), F.col("mg"), F.col("m")
    moment = F.avg(b * F.log(b)) if alpha == 1 else F.avg(F.log(b)) if alpha == 0 else F.avg(F.pow(b, F.lit(float(alpha))))
    # One pass over the users; what follows are the two rows of the groups.
    groups = benefits.groupBy("sensitive").agg(F.avg(b).alias("mg"), F.count("*").alias("ng"), moment.alias("f"))
    both = Window.partitionBy()
    groups = groups.withColumns({"n": F.sum("ng").over(both), "m": F.sum(mg * F.col("ng")).over(both) / F.sum("ng").over(both)})
    share, f, rg = F.col("ng") / F.col("n"), F.col("f"), mg / m
    if alpha == 1:
        inner, within, between = f / mg - F.log(mg), share * rg, share * rg * F.log(rg)
    elif alpha == 0:
        inner, within, between = F.log(mg) - f, share, -share * F.log(rg)
    else:
        scale = alpha * (alpha - 1)
        inner, within, between = (f / F.pow(mg, F.lit(float(alpha))) - 1) / scale, share * F.pow(rg, F.lit(float(alpha))), share * (F.pow(rg, F.lit(float(alpha))) - 1) / scale
    return groups.agg(F.sum(between).alias("between"), F.sum(within * inner).alias("within")).withColumn("total", F.col("between") + F.col("within"))


def plain_entropy_index(benefits: DataFrame, alpha: float) -> DataFrame:
    """Entropy index without groups; for alpha 0 with a further division by the mean."""
    rows = benefits.join(F.broadcast(benefits.agg(F.avg("benefit").alias("m"))), F.lit(True))
    r = F.col("benefit") / F.col("m")
    if alpha == 0:
        value = -F.avg(F.log(r) / F.col("m"))
    elif alpha == 1:
        value = F.avg(F.col("benefit") * F.log(r) / F.col("m"))
    else:
        value = F.avg((F.pow(r, F.lit(float(alpha))) - 1) / (alpha * (alpha - 1)))
    return rows.agg(value.alias("value"))


def polarization(scored: DataFrame) -> DataFrame:
    """Mean over items of the population variance of their scores."""
    return scored.groupBy("item_id").agg(F.var_pop("score").alias("v")).agg(F.avg("v").alias("value"))


def polarization_of_sums(sums: DataFrame) -> DataFrame:
    """``polarization`` from ``pair_sums.item_sums``."""
    return moments(sums, "item_id").agg(F.avg("var").alias("value"))


def loss_variance(scored: DataFrame, key: str) -> DataFrame:
    """Population variance over users, items or groups of the mean squared error."""
    e = F.col("score") - F.col("rating")
    return scored.groupBy(key).agg(F.avg(e * e).alias("loss")).agg(F.var_pop("loss").alias("value"))


def masked_rmse(scored: DataFrame, mask: Column) -> DataFrame:
    e = F.col("score") - F.col("rating")
    return scored.where(mask).agg(F.sqrt(F.sum(e * e) / F.count("*")).alias("value"))


def group_cluster_chi2(assigned: DataFrame, group: str, cluster: str, mass: str) -> DataFrame:
    """Chi-square of group x cluster from soft assignments."""
    cells = assigned.groupBy(group, cluster).agg(F.sum(mass).alias("o"))
    rows, cols = cells.groupBy(group).agg(F.sum("o").alias("r")), cells.groupBy(cluster).agg(F.sum("o").alias("c"))
    # All cells take part, those without mass too; groups and clusters are few.
    grid = rows.crossJoin(cols).join(cells, [group, cluster], "left").fillna({"o": 0.0}).withColumn("t", F.sum("r").over(Window.partitionBy(cluster)))
    e = F.col("r") * F.col("c") / F.col("t")
    return grid.agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("chi2"))


# Post-processing


def adjusted_scores(rows: DataFrame, train: Column, level: float = 1.0) -> DataFrame:
    """The rows that aren't ``train``, with ``adjusted``: score + level * the mean of rating - score of the item's train rows of the same group.

    Only items that both groups rate, in train and in the rest, are adjusted. Rows are dealt by item once.
    """
    w = Window.partitionBy("item_id")
    off = F.when(train, F.col("rating") - F.col("score"))
    in1, in2 = (F.max(F.when(~train, of(F.lit(True)))).over(w) for of in (_g1, _g2))
    out = rows.withColumns({"_a1": F.avg(_g1(off)).over(w), "_a2": F.avg(_g2(off)).over(w), "_both": in1 & in2}).where(~train)
    move = F.when(F.col("_both") & F.col("_a1").isNotNull() & F.col("_a2").isNotNull(), F.when(F.col("sensitive"), F.col("_a1")).otherwise(F.col("_a2")))
    return out.withColumn("adjusted", F.col("score") + F.lit(level) * F.coalesce(move, F.lit(0.0))).drop("_a1", "_a2", "_both")


def parity_adjust(train: DataFrame, test: DataFrame, split: bool = False) -> DataFrame:
    """Adds ``adjusted``: the train groups' difference of means is taken from group 1, or half from each."""
    gap = train.agg((F.avg(_g1(F.col("score"))) - F.avg(_g2(F.col("score")))).alias("d"))
    share = F.col("d") / 2 if split else F.col("d")
    move = F.when(F.col("sensitive"), -share).otherwise(share if split else F.lit(0.0))
    return test.join(F.broadcast(gap), F.lit(True)).withColumn("adjusted", F.col("score") + move).drop("d")


def equalise_scores(scored: DataFrame) -> DataFrame:
    """Adds ``adjusted``: each group's scores are moved and scaled to the mean and deviation of all."""
    total = scored.agg(F.avg("score").alias("mt"), F.stddev_pop("score").alias("st"))
    groups = scored.groupBy("sensitive").agg(F.avg("score").alias("mg"), F.stddev_pop("score").alias("sg"))
    return equalised_by(scored, total, groups)


def equalised_by(scored: DataFrame, total: DataFrame, groups: DataFrame) -> DataFrame:
    """``equalise_scores`` by the mean and deviation of all (one row, ``mt`` and ``st``) and of the groups (``mg``, ``sg``)."""
    rows = scored.join(F.broadcast(groups), "sensitive").join(F.broadcast(total), F.lit(True))
    scale = F.when(F.col("sg") > 0, F.col("st") / F.col("sg")).otherwise(0.0)
    return rows.withColumn("adjusted", (F.col("score") - F.col("mg")) * scale + F.col("mt")).drop("mt", "st", "mg", "sg")


def fair_rerank(candidates: DataFrame, k: int, epsilon: float, metric: str = "label") -> DataFrame:
    """Chooses k candidates of each user so that the groups' mean metric differs by at most ``epsilon``, if swaps allow.

    A heuristic for the integer program: from the top k by score, the better group gives up its hits
    at the lowest loss of score first, hit for non-hit. A round swaps one pair a user at most; rounds
    go on until the difference is small enough or no swap is left, at most ``k`` times.

    What comes in is no hit and what goes out is one, so neither moves again: a user's swaps are the
    same in whatever round they come. They are listed once, and rounds only count those that each user has made.
    """
    chosen, hit = F.col("chosen"), F.col(metric)
    kind = F.when(chosen & (hit > 0), "out").when(~chosen & (hit <= 0), "in").otherwise("stays")
    own = Window.partitionBy("user_id", "_kind")
    rows = candidates.withColumn("chosen", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")) <= k).withColumn("_kind", kind)
    places = {"_out": F.row_number().over(own.orderBy("score", "item_id")), "_in": F.row_number().over(own.orderBy(F.desc("score"), F.desc("item_id")))}
    rows = rows.withColumns(places).withColumn("_place", F.when(F.col("_kind") == "out", F.col("_out")).when(F.col("_kind") == "in", F.col("_in")))
    rows = kept(rows.where(chosen | (F.col("_place") <= k)).select("user_id", "item_id", "score", "sensitive", metric, "chosen", "_kind", "_place"))
    rate = F.sum(F.when(chosen, hit).otherwise(0))
    m = rows.groupBy("user_id", "sensitive").agg(rate.alias("value")).agg(F.sum(_g1(F.col("value"))).alias("s1"), F.sum(_g2(F.col("value"))).alias("s2"), F.count(_g1(F.lit(1))).alias("n1"), F.count(_g2(F.lit(1))).alias("n2")).first()
    sums, sizes = {True: m["s1"], False: m["s2"]}, {True: m["n1"], False: m["n2"]}
    score = {side: F.max(F.when(F.col("_kind") == side, F.col("score"))) for side in ("out", "in")}
    gives = {side: F.max(F.when(F.col("_kind") == side, hit)) for side in ("out", "in")}
    both = F.count_distinct("_kind") == 2
    steps = rows.where("_place IS NOT NULL").groupBy("user_id", "sensitive", "_place").agg((score["out"] - score["in"]).alias("loss"), (gives["out"] - gives["in"]).alias("gives"), both.alias("_both")).where("_both").drop("_both")
    steps, made = kept(steps), None
    for _ in range(k):
        if not sizes[True] or not sizes[False]:
            break
        gap = sums[True] / sizes[True] - sums[False] / sizes[False]
        if abs(gap) <= epsilon:
            break
        first = gap > 0
        need = math.ceil((abs(gap) - epsilon) * sizes[first] - 1e-9)
        better = steps.where(F.col("sensitive") == first)
        due = better.where("_place = 1") if made is None else better.join(made, "user_id", "left").where(F.col("_place") == F.coalesce("_made", F.lit(0)) + 1).drop("_made")
        swaps = numbered(due, ["loss", "user_id"], "_turn").where(F.col("_turn") < need)
        lost = swaps.agg(F.sum("gives")).first()[0]
        if lost is None:
            break
        sums[first] -= lost
        now = swaps.select("user_id", F.col("_place").alias("_made"))
        made = now if made is None else kept(made.union(now).groupBy("user_id").agg(F.max("_made").alias("_made")))
    if made is not None:
        moved = F.col("_place") <= F.coalesce("_made", F.lit(0))
        rows = rows.join(made, "user_id", "left").withColumn("chosen", F.when(F.col("_kind") == "out", ~moved).when(F.col("_kind") == "in", moved).otherwise(chosen))
    return rows.where("chosen").select("user_id", "item_id", "score", "sensitive", metric)
