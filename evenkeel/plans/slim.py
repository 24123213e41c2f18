"""Sparse linear models of neighbours: elastic-net coordinate descent on rows of a Gram matrix.

A target's rating row is approximated by weights of its nearest neighbours' rows. Each target's small
system comes from the sparse Gram matrix by joins; all targets are solved in one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.operators.numbering import kept
from evenkeel.operators.prepare import partner_sums, profile_pairs


def gram(ratings: DataFrame, of: str, by: str) -> DataFrame:
    """Products of the rating rows of ``of`` that meet in ``by``: (i1, i2, g) with i1 < i2; absent pairs are 0."""
    return profile_pairs(ratings.select(by, of, "rating"), by, of, "rating").groupBy("i1", "i2").agg(F.sum(F.col("w1") * F.col("w2")).alias("g"))


def slim_systems(ratings: DataFrame, of: str, by: str, k: int, signs: DataFrame | None = None) -> DataFrame:
    """The systems of all targets: (target, others, norms, products, signs, cells).

    ``others`` are the ``k`` neighbours of highest cosine, ties by id; ``norms`` their squared lengths,
    ``products`` those with the target, ``cells`` (x, y, g) the products of two of them that aren't 0.
    ``signs`` (of, sign) are +1 or -1 by group, 0 where unknown. A target without neighbours has no row.
    """
    norms = ratings.groupBy(F.col(of).alias("id")).agg(F.sum(F.col("rating") * F.col("rating")).alias("norm"))
    # Each rating has its row's length with it, so that no pair meets the lengths.
    sums = partner_sums(ratings.join(norms.withColumnRenamed("id", of), of).select(by, of, "rating", "norm"), by, of, "rating", carried="norm")
    met = sums.select(F.col("i1").alias("target"), F.col("i2").alias("other"), "g", F.col("c1").alias("own"), F.col("c2").alias("norm"))
    met = met.withColumn("similarity", F.round(F.col("g") / F.sqrt(F.col("own") * F.col("norm")), 6))
    order = Window.partitionBy("target").orderBy(F.desc("similarity"), "other")
    near = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("target", "other", "norm", "g", "rank")
    near = kept(near if signs is None else near.join(signs.toDF("other", "sign"), "other", "left"))
    signed = near.withColumn("sign", F.lit(0.0)) if signs is None else near.fillna({"sign": 0.0})
    # A target's neighbours bring their rows as arrays; what two of them have in common meets at the target.
    profiles = ratings.groupBy(F.col(of).alias("other")).agg(F.collect_list(F.struct(by, "rating")).alias("p"))
    profiles = profiles.select("other", F.col(f"p.{by}").alias("i"), F.col("p.rating").alias("w"))
    rows = near.select("target", "other", "rank").join(profiles, "other").drop("other").repartition("target")
    cells = rows.select("target", "rank", F.inline(F.arrays_zip("i", "w")).alias("i", "w")).groupBy("target", "i").agg(F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("n")).where(F.size("n") > 1)
    cells = cells.select("target", "n", F.explode("n").alias("x")).select("target", "x", F.explode(F.filter("n", lambda y: y["rank"] > F.col("x.rank"))).alias("y"))
    cells = cells.groupBy("target", F.col("x.rank").alias("x"), F.col("y.rank").alias("y")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("g"))
    cells = cells.groupBy("target").agg(F.collect_list(F.struct("x", "y", "g")).alias("cells"))
    rows = signed.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "norm", "g", "sign"))).alias("n"))
    rows = rows.select("target", *[F.col(f"n.{c}").alias(name) for c, name in (("other", "others"), ("norm", "norms"), ("g", "products"), ("sign", "signs"))])
    return rows.join(cells, "target", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<x:int,y:int,g:double>>")))


def descend(matrix: np.ndarray, products: np.ndarray, signs: np.ndarray, l1: float, l2: float, l3: float, passes: int, tolerance: float) -> np.ndarray:
    """Weights that minimise half the squared error, l1 |w|, l2 / 2 |w|^2 and l3 / 2 (signs . w)^2, one coordinate after the other from 0."""
    w = np.zeros(len(products))
    for _ in range(passes):
        moved = 0.0
        for c in range(len(w)):
            rest = products[c] - matrix[c] @ w + matrix[c, c] * w[c] - l3 * signs[c] * (signs @ w - signs[c] * w[c])
            new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (matrix[c, c] + l2 + l3 * signs[c] ** 2)
            moved, w[c] = max(moved, abs(new - w[c])), new
        if moved <= tolerance:
            break
    return w


def slim_weights(systems: DataFrame, l1: float, l2: float, l3: float = 0.0, passes: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """Weights that aren't 0: (target, other, weight). ``l3`` weighs the balance of the two groups among the neighbours."""

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for norms, products, signs, cells in zip(batch["norms"], batch["products"], batch["signs"], batch["cells"]):
                matrix = np.diag(np.asarray(norms, float))
                for cell in cells:
                    matrix[cell["x"] - 1, cell["y"] - 1] = matrix[cell["y"] - 1, cell["x"] - 1] = cell["g"]
                out.append(descend(matrix, np.asarray(products, float), np.asarray(signs, float), l1, l2, l3, passes, tolerance).tolist())
            yield pd.Series(out)

    weights = F.pandas_udf(solved, "array<double>")(F.struct("norms", "products", "signs", "cells"))
    rows = systems.select("target", F.arrays_zip("others", weights.alias("weights")).alias("z"))
    return rows.select("target", F.inline("z").alias("other", "weight")).where("weight <> 0")


def slim_scores(ratings: DataFrame, weights: DataFrame, pairs: DataFrame, of: str, by: str) -> DataFrame:
    """Scores of ``pairs`` (of, by): the weighted sum of the neighbours' ratings; pairs that no neighbour rates have none."""
    rated = ratings.select(F.col(of).alias("other"), by, "rating")
    joined = pairs.join(weights.withColumnRenamed("target", of), of).join(rated, ["other", by])
    return joined.groupBy(of, by).agg(F.sum(F.col("weight") * F.col("rating")).alias("score"))
