"""Re-ranking under a bound on the groups' difference, by the Lagrangian dual.

Chosen are k items a user, of the greatest sum of scores such that the mean metric of the two groups
differs by ``epsilon`` at most. For one multiplier the problem falls apart into a top k for each user
under moved scores; the multiplier is searched, many at a time, and the dual bound certifies how far
the chosen lists can be from the best.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.operators.numbering import kept, running


class Certificate(NamedTuple):
    """``value`` of the lists, ``bound`` that no feasible lists exceed, the groups' ``gap``, and whether it can be met."""

    multiplier: float
    value: float
    bound: float
    gap: float
    feasible: bool

    @property
    def missing(self) -> float:
        return self.bound - self.value


def priced(candidates: DataFrame, k: int, metric: str = "precision") -> DataFrame:
    """Adds ``price``: what choosing a row adds to the first group's mean metric, or takes off the second's.

    ``candidates`` are (user_id, item_id, score, label, sensitive); the metric is precision, recall or
    f1. Users without a label count in neither mean. Rows of one user and label have one price, so
    no multiplier chooses one beyond the first ``k`` of them: the others go.
    """
    user = Window.partitionBy("user_id")
    rows = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy("user_id", "label").orderBy(F.desc("score"), "item_id")))
    rows = rows.withColumn("_labels", F.sum("label").over(user)).where(F.col("_rank") <= k)
    share = {"precision": F.col("label") / k, "recall": F.try_divide("label", "_labels"), "f1": 2 * F.col("label") / (F.col("_labels") + k)}[metric]
    groups = candidates.groupBy("user_id", "sensitive").agg(F.sum("label").alias("l")).where("l > 0").groupBy("sensitive").agg(F.count("*").alias("_users"))
    signed = F.when(F.col("sensitive"), share).otherwise(-share) / F.col("_users")
    joined = rows.join(F.broadcast(groups), "sensitive", "left")  # two rows at most
    return joined.withColumn("price", F.coalesce(signed.cast("double"), F.lit(0.0))).drop("_rank", "_labels", "_users")


def lists_at(rows: DataFrame, k: int, multipliers: list[float] | Column) -> DataFrame:
    """The ``k`` best rows of each user by score - multiplier * price, for every multiplier; ties by item."""
    many = multipliers if isinstance(multipliers, Column) else F.array(*[F.lit(float(m)) for m in multipliers])
    moved = rows.withColumn("multiplier", F.explode(many)).withColumn("moved", F.round(F.col("score") - F.col("multiplier") * F.col("price"), 9))
    order = Window.partitionBy("user_id", "multiplier").orderBy(F.desc("moved"), "item_id")
    return moved.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def dual_values(rows: DataFrame, k: int, epsilon: float, multipliers: list[float]) -> DataFrame:
    """(multiplier, value, gap, bound): the lists' scores and gap, and the bound of all feasible lists' scores."""
    lists = lists_at(rows, k, multipliers)
    gap, value = F.sum("price"), F.sum("score")
    return lists.groupBy("multiplier").agg(value.alias("value"), gap.alias("gap"), (value - F.col("multiplier") * gap + F.abs("multiplier") * epsilon).alias("bound"))


def dual_rerank(candidates: DataFrame, k: int, epsilon: float, metric: str = "precision", width: int = 8, rounds: int = 9) -> tuple[DataFrame, Certificate]:
    """The re-ranked lists (user_id, item_id, score, label, sensitive) and their certificate.

    A round tries ``width`` multipliers in one job and keeps the two between which the gap falls to
    ``epsilon``. The lists of the two differ in users whose swaps cost about the same for what they
    give: users take the fairer lists in the order of their ids until the gap is met.
    Where even the largest multiplier leaves a wider gap no lists are feasible; then its lists, the
    fairest, are returned.
    """
    rows = kept(priced(candidates, k, metric))
    spread = rows.where("price <> 0").agg(F.min(F.abs("price")).alias("least")).join(rows.agg((F.max("score") - F.min("score")).alias("range")), F.lit(True)).first()
    start = dual_values(rows, k, epsilon, [0.0]).first()
    if start is None or spread["least"] is None or abs(start["gap"]) <= epsilon + 1e-12:
        lists = lists_at(rows, k, [0.0])
        found = Certificate(0.0, start["value"] if start else 0.0, start["value"] if start else 0.0, start["gap"] if start else 0.0, True)
        return lists.select("user_id", "item_id", "score", "label", "sensitive"), found
    side = 1.0 if start["gap"] > 0 else -1.0
    low, high = 0.0, spread["range"] / spread["least"] + 1.0
    bound = start["value"]
    end = dual_values(rows, k, epsilon, [side * high]).first()
    feasible = side * end["gap"] <= epsilon + 1e-12
    while feasible and rounds and high - low > 1e-9:
        tried = [low + (high - low) * (i + 1) / (width + 1) for i in range(width)]
        for r in sorted(dual_values(rows, k, epsilon, [side * t for t in tried]).collect(), key=lambda r: abs(r["multiplier"])):
            bound = min(bound, r["bound"])
            if side * r["gap"] > epsilon + 1e-12:
                low = abs(r["multiplier"])
            elif abs(r["multiplier"]) > low:
                high = abs(r["multiplier"])
                break
        rounds -= 1
    if not feasible:
        lists = lists_at(rows, k, [side * high])
        return lists.select("user_id", "item_id", "score", "label", "sensitive"), Certificate(side * high, end["value"], bound, end["gap"], False)
    lists = kept(lists_at(rows, k, [side * low, side * high]))
    fair = F.col("multiplier") == side * high
    users = lists.groupBy("user_id").agg((side * F.sum(F.when(fair, -F.col("price")).otherwise(F.col("price")))).alias("gives")).where("gives > 1e-15")
    need = side * lists.where(~fair).agg(F.sum("price")).first()[0] - epsilon
    turned = running(users, "user_id", {"upto": "gives"}).where(F.col("upto") - F.col("gives") < need).select("user_id", F.lit(True).alias("_fair"))
    chosen = lists.join(turned, "user_id", "left").where(fair == F.coalesce("_fair", F.lit(False)))
    chosen = kept(chosen.select("user_id", "item_id", "score", "label", "sensitive", "price"))
    own = chosen.agg(F.sum("score").alias("value"), F.sum("price").alias("gap")).first()
    return chosen.drop("price"), Certificate(side * high, own["value"], bound, own["gap"], True)
