"""Pivots, overlays and long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(rows: DataFrame, keys: list[str], column: str, values: list, value: str) -> DataFrame:
    """Long to wide over stated values; the smallest value of a cell counts."""
    return rows.groupBy(*keys).pivot(column, values).agg(F.min(value))


def melt(rows: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return rows.unpivot(keys, columns, name, value)


def overlay(base: DataFrame, update: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of ``update`` where they aren't null, else those of ``base``."""
    other = update.select(*keys, F.col(value).alias("_new"))
    return base.join(other, keys, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def complete(users: DataFrame, items: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of all user x item pairs, those missing filled with the user's mean; the result has that size."""
    means = scores.groupBy("user_id").agg(F.avg("score").alias("_mean"))
    grid = users.select("user_id").crossJoin(items.select("item_id"))
    return grid.join(scores, ["user_id", "item_id"], "left").join(means, "user_id", "left").withColumn("score", F.coalesce("score", "_mean")).drop("_mean")


def completed_sums(users: DataFrame, items: DataFrame, scores: DataFrame) -> DataFrame:
    """Of ``complete`` each user's number of cells ``n`` and their sum ``total``, without the product; users without scores have no total."""
    known = scores.join(items.select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("_known"), F.sum("score").alias("_sum"))
    means = scores.groupBy("user_id").agg(F.avg("score").alias("_mean"))
    return _completed_of(users, items, known, means)


def completed_of_sums(users: DataFrame, items: DataFrame, sums: DataFrame, known: DataFrame) -> DataFrame:
    """``completed_sums`` of each user's number ``n`` and ``total`` of scores: of all, and of those of ``items`` (``known``)."""
    known = known.select("user_id", F.col("n").alias("_known"), F.col("total").alias("_sum"))
    return _completed_of(users, items, known, sums.select("user_id", (F.col("total") / F.col("n")).alias("_mean")))


def _completed_of(users: DataFrame, items: DataFrame, known: DataFrame, means: DataFrame) -> DataFrame:
    size = items.agg(F.count("*").alias("n"))
    rows = users.select("user_id").join(known, "user_id", "left").join(means, "user_id", "left").join(F.broadcast(size), F.lit(True))
    filled = (F.col("n") - F.coalesce("_known", F.lit(0))) * F.col("_mean")
    return rows.select("user_id", "n", (F.coalesce("_sum", F.lit(0.0)) + filled).alias("total"))


def union_parts(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of several tables with a tag; columns that one lacks are null."""
    out = None
    for name, rows in parts.items():
        tagged = rows.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
