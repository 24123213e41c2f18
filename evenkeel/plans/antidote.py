"""Ratings of made-up users that bring the losses of two groups together, by the gradient through least squares.

Tables: ``ratings`` (user_id, item_id, rating), ``users`` (user_id, sensitive boolean, vector), ``fakes``
(fake_id, vector), ``made`` (item_id, fake_id, rating): every made-up user rates every item. Vectors of users are
held; an item's vector is the ridge solution over its ratings, those of made-up users included, and so linear in these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.scalars import dot
from evenkeel.operators.numbering import kept

LOW, HIGH = 0.0, 5.0


def _at(name: str, i: int) -> Column:
    return F.get(name, F.lit(i))


def _product(matrix: str, vector: str, rank: int) -> Column:
    """A square matrix, kept row by row, times a vector."""
    return F.array(*[sum((_at(matrix, i * rank + j) * _at(vector, j) for j in range(rank)), F.lit(0.0)) for i in range(rank)])


def item_systems(ratings: DataFrame, users: DataFrame, fakes: DataFrame, rank: int, ridge: float) -> DataFrame:
    """For each rated item (item_id, inverse, plain): the inverse of its normal matrix, and its right side without made-up ratings.

    Outer products are summed before anything is solved; those of all made-up users are one row.
    """

    @F.pandas_udf("array<double>")
    def inverted(cells: pd.Series) -> pd.Series:
        square = np.array(cells.tolist(), dtype=float).reshape(-1, rank, rank) + ridge * np.eye(rank)
        return pd.Series(list(np.linalg.inv(square).reshape(-1, rank * rank)))

    cells = [_at("vector", i) * _at("vector", j) for i in range(rank) for j in range(rank)]
    fixed = fakes.agg(F.array(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in cells]).alias("fixed"))
    rated = ratings.join(users.select("user_id", "vector"), "user_id").groupBy("item_id")
    sums = rated.agg(F.array(*[F.sum(c) for c in cells]).alias("own"), F.array(*[F.sum(_at("vector", i) * F.col("rating")) for i in range(rank)]).alias("plain"))
    both = sums.join(F.broadcast(fixed), F.lit(True))
    return both.select("item_id", inverted(F.zip_with("own", "fixed", lambda a, b: a + b)).alias("inverse"), "plain")


def _errors(ratings: DataFrame, users: DataFrame, fakes: DataFrame, systems: DataFrame, made: DataFrame, rank: int, *by: str) -> DataFrame:
    """(*by, item_id, sensitive, vector, inverse, error) of each rating of a user with a group; ``by`` are further keys of ``made``."""
    shares = made.join(fakes, "fake_id").groupBy(*by, "item_id").agg(F.array(*[F.sum(F.col("rating") * _at("vector", i)) for i in range(rank)]).alias("added"))
    solved = systems.join(shares, "item_id").withColumn("right", F.zip_with("plain", "added", lambda a, b: a + b))
    solved = solved.select(*by, "item_id", "inverse", _product("inverse", "right", rank).alias("v"))
    rows = ratings.join(users.where("sensitive IS NOT NULL").select("user_id", "sensitive", "vector"), "user_id").join(solved, "item_id")
    return rows.select(*by, "item_id", "sensitive", "vector", "inverse", (dot("vector", "v") - F.col("rating")).alias("error"))


def _group_losses(errors: DataFrame, *by: str) -> DataFrame:
    """Mean squared errors and counts of both groups."""
    squared, of = F.col("error") * F.col("error"), {"true": F.col("sensitive"), "false": ~F.col("sensitive")}
    return errors.groupBy(*by).agg(*[F.avg(F.when(g, squared)).alias(f"loss_{x}") for x, g in of.items()], *[F.count(F.when(g, 1)).alias(f"n_{x}") for x, g in of.items()])


def antidote_slopes(ratings: DataFrame, users: DataFrame, fakes: DataFrame, systems: DataFrame, made: DataFrame, rank: int) -> DataFrame:
    """``made`` with ``slope``: the derivative by each made-up rating of the variance of the two groups' losses.

    An error's share of the derivative reaches an item's vector through its user's vector, and a made-up
    rating moves the item's vector by ``inverse * fake``. Items that nobody rated are left out.
    """
    errors = _errors(ratings, users, fakes, systems, made, rank)
    pull = (F.col("loss_true") - F.col("loss_false")) * F.col("error") * F.when(F.col("sensitive"), F.try_divide(F.lit(1.0), "n_true")).otherwise(-F.try_divide(F.lit(1.0), F.col("n_false")))
    pulled = errors.join(F.broadcast(_group_losses(errors)), F.lit(True)).withColumn("pull", pull)
    sums = pulled.groupBy("item_id").agg(F.first("inverse").alias("inverse"), F.array(*[F.sum(F.col("pull") * _at("vector", i)) for i in range(rank)]).alias("pulled"))
    ways = sums.select("item_id", _product("inverse", "pulled", rank).alias("way"))
    return made.join(ways, "item_id").join(fakes, "fake_id").select("item_id", "fake_id", "rating", dot("way", "vector").alias("slope"))


def relative_slopes(slopes: DataFrame) -> DataFrame:
    """Slopes in times of the largest, so that a step of 1 moves one rating by 1; zero where all are."""
    most = slopes.agg(F.max(F.abs("slope")).alias("most"))
    scaled = F.when(F.col("most") > 0, F.col("slope") / F.col("most")).otherwise(0.0)
    return slopes.join(F.broadcast(most), F.lit(True)).select("item_id", "fake_id", "rating", scaled.alias("slope"))


def _moved(step: Column) -> Column:
    return F.greatest(F.least(F.col("rating") - step * F.col("slope"), F.lit(HIGH)), F.lit(LOW))


def antidote_losses(ratings: DataFrame, users: DataFrame, fakes: DataFrame, systems: DataFrame, slopes: DataFrame, rank: int, steps: list[float]) -> DataFrame:
    """(step, loss_true, loss_false) after each of some steps against the slopes, projected; all steps in one plan."""
    every = slopes.withColumn("step", F.explode(F.array(*[F.lit(float(t)) for t in steps])))
    made = every.select("step", "item_id", "fake_id", _moved(F.col("step")).alias("rating"))
    return _group_losses(_errors(ratings, users, fakes, systems, made, rank, "step"), "step").select("step", "loss_true", "loss_false")


def fit_antidote(ratings: DataFrame, users: DataFrame, fakes: DataFrame, made: DataFrame, rank: int, ridge: float, steps: list[float], rounds: int = 10) -> tuple[DataFrame, list[float]]:
    """Made-up ratings after projected steps, and the variance of the groups' losses at the start and after each.

    A round takes the best of ``steps``; rounds end when none makes the variance smaller or a group has no ratings. Only a
    row for each step comes to the driver.
    """
    systems = kept(item_systems(ratings, users, fakes, rank, ridge))
    history: list[float] = []
    for _ in range(rounds):
        slopes = kept(relative_slopes(antidote_slopes(ratings, users, fakes, systems, made, rank)))
        rows = antidote_losses(ratings, users, fakes, systems, slopes, rank, [0.0, *steps]).collect()
        values = {r["step"]: ((r["loss_true"] - r["loss_false"]) / 2) ** 2 for r in rows if r["loss_true"] is not None and r["loss_false"] is not None}
        if not values:
            break
        history = history or [values[0.0]]
        best = min(values, key=lambda t: (values[t], t))
        if values[best] >= history[-1]:
            break
        history.append(values[best])
        made = slopes.select("item_id", "fake_id", _moved(F.lit(best)).alias("rating"))
    return made, history
