"""Factor and topic models as iterated DataFrame plans, and the losses they minimise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions.scalars import dot
from evenkeel.operators.numbering import kept
from evenkeel.plans.models import als_step


def factor_scores(pairs: DataFrame, users: DataFrame, items: DataFrame, mu: float) -> DataFrame:
    """Adds ``score`` = mu + bu + bi + p . q; unknown ids have zero parameters.

    ``users`` has (user_id, bu, p) and ``items`` (item_id, bi, q), with arrays p and q.
    """
    joined = pairs.join(users, "user_id", "left").join(items, "item_id", "left")
    product = F.coalesce(dot("p", "q"), F.lit(0.0))
    return joined.withColumn("score", F.lit(mu) + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0)) + product).drop("bu", "bi", "p", "q")


def factor_loss(ratings: DataFrame, users: DataFrame, items: DataFrame, mu: float, penalty: float) -> DataFrame:
    """Half the squared error plus half the penalty times the squared parameters."""
    scored = factor_scores(ratings, users, items, mu)
    error = scored.agg(F.sum(F.pow(F.col("score") - F.col("rating"), F.lit(2.0))).alias("e"))
    size_u = users.agg(F.sum(F.col("bu") * F.col("bu") + dot("p", "p")).alias("u"))
    size_i = items.agg(F.sum(F.col("bi") * F.col("bi") + dot("q", "q")).alias("i"))
    one = error.join(size_u, F.lit(True)).join(size_i, F.lit(True))
    return one.select((0.5 * F.col("e") + 0.5 * penalty * (F.col("u") + F.col("i"))).alias("loss"))


def _products(events: DataFrame, user_topics: DataFrame, item_topics: DataFrame, parents: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_z``, an array of (z, w): P(z | user) P(item | z) of the topics that both sides have."""
    users = user_topics.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("z", "p"))).alias("_u"))
    items = item_topics.groupBy(*parents, "item_id").agg(F.sort_array(F.collect_list(F.struct("z", "q"))).alias("_i"))
    both = F.flatten(F.transform("_u", lambda u: F.transform(F.filter("_i", lambda i: i["z"] == u["z"]), lambda i: F.struct(u["z"].alias("z"), (u["p"] * i["q"]).alias("w")))))
    return events.join(users, "user_id").join(items, [*parents, "item_id"]).select(*events.columns, both.alias("_z"))


def plsa_step(events: DataFrame, user_topics: DataFrame, item_topics: DataFrame, parents: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One EM step of P(user, item) = sum over z of P(z | user) P(item | z).

    ``events`` (user_id, item_id, n), ``user_topics`` (user_id, z, p) and ``item_topics`` (item_id, z, q);
    returns both tables anew. An event meets the topics of its user and item as two arrays and is no more
    than one row in both joins. ``parents`` are
    columns of events that ``item_topics`` has too, observed attributes on which items depend.
    """
    products = _products(events, user_topics, item_topics, parents)
    total = F.aggregate("_z", F.lit(0.0), lambda s, x: s + x["w"])
    mass = products.withColumn("_t", total).select(*events.columns, "_t", F.inline("_z")).withColumn("m", F.when(F.col("_t") > 0, F.col("n") * F.col("w") / F.col("_t")).otherwise(0.0))
    by_user = mass.groupBy("user_id", "z").agg(F.sum("m").alias("m"))
    users = by_user.select("user_id", "z", F.try_divide("m", F.sum("m").over(Window.partitionBy("user_id"))).alias("p"))
    by_item = mass.groupBy(*parents, "item_id", "z").agg(F.sum("m").alias("m"))
    items = by_item.select(*parents, "item_id", "z", F.try_divide("m", F.sum("m").over(Window.partitionBy(*parents, "z"))).alias("q"))
    return users, items


def fit_plsa(events: DataFrame, topics: int, rounds: int = 50, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame, list[float]]:
    """Both tables of topics by EM, and the likelihood after each round.

    Rounds end when the likelihood grows by less than ``tolerance`` of its size. Topics begin unlike
    each other by a hash. The events are kept, read several times a round, and so are the tables of a round, so the plan doesn't grow with the rounds.
    """
    events = kept(events)
    z = F.explode(F.sequence(F.lit(0), F.lit(topics - 1))).alias("z")

    def begin(column: str, name: str, whole: str) -> DataFrame:
        weights = events.select(column).distinct().select(column, z).withColumn("w", 1 + F.pmod(F.xxhash64(column, "z"), F.lit(1000)) / 1000)
        return weights.withColumn(name, F.col("w") / F.sum("w").over(Window.partitionBy(whole))).drop("w")

    users, items = begin("user_id", "p", "user_id"), begin("item_id", "q", "z")
    history: list[float] = []
    for _ in range(rounds):
        made = plsa_step(events, users, items)
        users, items = kept(made[0]), kept(made[1])
        now = plsa_likelihood(events, users, items).first()[0]
        history.append(now)
        if now is None or (len(history) > 1 and now - history[-2] < tolerance * abs(now)):
            break
    return users, items, history


def fit_als(ratings: DataFrame, rank: int, ridge: float, rounds: int = 20, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame, list[float]]:
    """User and item vectors by alternating least squares, and the training RMSE after each round.

    Item vectors begin as ones, with the first element of each moved by a hash of the item. Rounds end
    when the RMSE sinks by less than ``tolerance``. The ratings are kept, since a round reads them three times.
    """
    ratings = kept(ratings.select("user_id", "item_id", "rating"))
    start = F.concat(F.array(1 + F.pmod(F.xxhash64("item_id"), F.lit(1000)) / 1000), F.array_repeat(F.lit(1.0), rank - 1))
    items = ratings.select("item_id").distinct().withColumn("vector", start)
    history: list[float] = []
    users = None
    for _ in range(rounds):
        users = kept(als_step(ratings, items, "user_id", "item_id", rank, ridge))
        items = kept(als_step(ratings, users, "item_id", "user_id", rank, ridge))
        scored = ratings.join(users.withColumnRenamed("vector", "p"), "user_id").join(items.withColumnRenamed("vector", "q"), "item_id")
        history.append(scored.agg(F.sqrt(F.avg(F.pow(dot("p", "q") - F.col("rating"), F.lit(2.0))))).first()[0])
        if history[-1] is None or (len(history) > 1 and history[-2] - history[-1] < tolerance):
            break
    return users, items, history


def plsa_likelihood(events: DataFrame, user_topics: DataFrame, item_topics: DataFrame) -> DataFrame:
    """Sum of n log P(item | user)."""
    per = _products(events, user_topics, item_topics).select("n", F.aggregate("_z", F.lit(0.0), lambda s, x: s + x["w"]).alias("l"), F.size("_z").alias("_size")).where("_size > 0")
    return per.agg(F.sum(F.col("n") * F.log("l")).alias("likelihood"))


def project(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The column moved to the nearest place in [low, high]."""
    return rows.withColumn(column, F.greatest(F.least(F.col(column), F.lit(high)), F.lit(low)))


def line_search(rows: DataFrame, start: str, slope: str, target: str, steps: list[float], low: float, high: float) -> DataFrame:
    """The mean squared error at each step along a slope, projected; all steps in one aggregation."""
    def moved(t: float) -> Column:
        return F.greatest(F.least(F.col(start) + F.lit(t) * F.col(slope), F.lit(high)), F.lit(low))

    sums = rows.agg(*[F.avg(F.pow(moved(t) - F.col(target), F.lit(2.0))).alias(f"s{i}") for i, t in enumerate(steps)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(t).alias("step"), F.col(f"s{i}").alias("loss")) for i, t in enumerate(steps)])))
