"""Completed score matrices kept sparse: stored cells, a default for each user, no product of users and items."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.operators.numbering import kept, numbered
from evenkeel.plans.pair_places import micro
from evenkeel.plans.pair_sums import CENTRE, exact

#: Factors that spread item numbers and user ids over the places of a made-up row.
ITEM_FACTOR, USER_FACTOR = 1000003, 7919


@dataclass(frozen=True)
class Completed:
    """A matrix with a value in every cell.

    ``cells`` (user_id, item_id, score) are stored; None where their sums alone are known. ``rows`` (user_id, number, n_cells, fill, turn) are all users:
    cells that aren't stored have the value ``fill``, or, where it is null, that of a made-up row.
    ``items`` (item_id, number, place) are all items; numbers are dense, from 0, in order of the ids.
    ``shape`` is one row (n, low, high): the number of items and the range of the stored scores.
    """

    cells: DataFrame | None
    rows: DataFrame
    items: DataFrame
    shape: DataFrame


def complete(users: DataFrame, items: DataFrame, scores: DataFrame) -> Completed:
    """The scores of all ``users`` (user_id) for all ``items`` (item_id), from those of ``scores`` (user_id, item_id, score).

    Missing cells of a user with scores are their mean, to six places. A user without any gets a made-up row: evenly
    spread values between the least and the largest score, each item's place moved by the user's hash, so that
    no two items tie. Scores of unknown users or items and null scores are left out; ids are taken once.
    """
    numbers, people = _numbers(users, items)
    cells = scores.select("user_id", "item_id", "score").where("score IS NOT NULL")
    cells = cells.join(people.select("user_id"), "user_id", "left_semi").join(numbers.select("item_id"), "item_id", "left_semi").select("user_id", "item_id", "score")
    means = cells.groupBy("user_id").agg(F.count("*").alias("n_cells"), F.avg("score").alias("mean"))
    return _completed(cells, people, numbers, means, cells.agg(F.min("score").alias("low"), F.max("score").alias("high")))


def complete_sums(users: DataFrame, items: DataFrame, means: DataFrame) -> Completed:
    """``complete`` without the cells, from each user's number of scores for ``items``, their mean, and the least and the greatest (user_id, n_cells, mean, low, high)."""
    numbers, people = _numbers(users, items)
    means = means.join(people.select("user_id"), "user_id", "left_semi")
    return _completed(None, people, numbers, means.select("user_id", "n_cells", "mean"), means.agg(F.min("low").alias("low"), F.max("high").alias("high")))


def _numbers(users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    items = numbered(items.select("item_id").where("item_id IS NOT NULL").distinct(), [F.col("item_id")], "number")
    return items, numbered(users.select("user_id").where("user_id IS NOT NULL").distinct(), [F.col("user_id")], "number")


def _completed(cells: DataFrame | None, people: DataFrame, numbers: DataFrame, means: DataFrame, ends: DataFrame) -> Completed:
    size = numbers.agg(F.count("*").alias("n"))
    places = numbers.join(F.broadcast(size), F.lit(True)).select("item_id", "number", F.pmod(F.col("number") * ITEM_FACTOR, F.col("n")).alias("place"))
    means = means.select("user_id", "n_cells", F.round(F.col("mean") + 1e-9, 6).alias("fill"))
    rows = people.join(means, "user_id", "left").join(F.broadcast(size), F.lit(True))
    turn = F.when(F.col("fill").isNull(), F.pmod(F.col("user_id") * USER_FACTOR, F.col("n")))
    rows = rows.select("user_id", "number", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "fill", turn.alias("turn"))
    shape = size.join(ends.select(F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high")), F.lit(True))
    return Completed(cells, rows, places, shape)


def _made_up(step: Column) -> Column:
    """The value of a made-up row at a step from 0 to n - 1."""
    return F.col("low") + (F.col("high") - F.col("low")) * step / F.col("n")


def completed_scores(matrix: Completed, pairs: DataFrame) -> DataFrame:
    """Adds ``score`` to ``pairs`` (user_id, item_id): three equi-joins. Pairs of unknown users or items go."""
    known = pairs.join(matrix.rows.select("user_id", "fill", "turn"), "user_id").join(matrix.items.select("item_id", "place"), "item_id")
    found = known.join(matrix.cells, ["user_id", "item_id"], "left").join(F.broadcast(matrix.shape), F.lit(True))
    score = F.coalesce("score", "fill", _made_up((F.col("place") + F.col("turn")) % F.col("n")))
    return found.select(*pairs.columns, score.alias("score"))


def completed_top_k(matrix: Completed, k: int) -> DataFrame:
    """The k best items of every user over the whole row: (user_id, item_id, score, rank), ties by id.

    Of the cells with the default only those with the k smallest ids can be among the best. They are
    among the first ``n_cells + k`` items, so the work grows with the stored cells. Of a made-up row the k best
    places are known beforehand.
    """
    rows = matrix.rows.join(F.broadcast(matrix.shape), F.lit(True)).where("n > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.col("n_cells") + k) - 1)).alias("number")
    free = rows.where("fill IS NOT NULL").select("user_id", "fill", first).join(matrix.items.select("number", "item_id"), "number")
    free = free.join(matrix.cells.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    free = free.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("item_id"))).where(F.col("place") <= k)
    return _best_of(matrix, matrix.cells, free.select("user_id", "item_id", "fill"), rows, k)


def top_k_of_best(matrix: Completed, k: int, best: DataFrame, stored: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``completed_top_k`` from each user's k ``best`` stored cells (user_id, item_id, score), ties by id.

    ``stored`` gives the stored cells of a table of users and one of items. The first items are tried for cells with the
    default, and four times as many for the users to whom these leave less than k, until there are enough or no more items.
    """
    rows = matrix.rows.join(F.broadcast(matrix.shape), F.lit(True)).where("n > 0")
    left, most, free = rows.where("fill IS NOT NULL").select("user_id", "fill", "n"), 8 * k + 60, None
    while True:
        first = matrix.items.where(F.col("number") < most).select("item_id")
        held = stored(left, first).groupBy("user_id").agg(F.collect_set("item_id").alias("_held"))
        ids = first.agg(F.sort_array(F.collect_list("item_id")).alias("_first"))
        tried = left.join(held, "user_id", "left").join(F.broadcast(ids), F.lit(True))
        open_ = F.array_except("_first", F.coalesce("_held", F.array().cast("array<bigint>")))
        tried = kept(tried.select("user_id", "fill", "n", F.slice(open_, 1, k).alias("_open")))
        short = (F.size("_open") < k) & (F.col("n") > most)
        found = tried.where(~short).select("user_id", F.explode("_open").alias("item_id"), "fill")
        free = found if free is None else free.union(found)
        left = tried.where(short).select("user_id", "fill", "n")
        if left.isEmpty():
            break
        most *= 4
    return _best_of(matrix, best, free, rows, k)


def _best_of(matrix: Completed, cells: DataFrame, free: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k).cast("long")))).alias("back")
    made = rows.where("fill IS NULL").select("user_id", "turn", "n", "low", "high", steps).withColumn("step", F.col("n") - F.col("back"))
    made = made.withColumn("place", F.pmod(F.col("step") - F.col("turn"), F.col("n"))).join(matrix.items.select("place", "item_id"), "place")
    best = cells.union(free).union(made.select("user_id", "item_id", _made_up(F.col("step"))))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def completed_ranks(matrix: Completed, pairs: DataFrame) -> DataFrame:
    """The places of ``pairs`` (user_id, item_id) in the whole rows: (user_id, item_id, score, rank long), from 1, ties by id.

    Stored cells ahead of a pair are counted by running sums over the user's stored cells and pairs; the cells
    with the default are ahead of it all together or, at the same score, as many as have a smaller id.
    """
    asked = completed_scores(matrix, pairs.select("user_id", "item_id").distinct())
    both = asked.withColumn("stored", F.lit(0)).union(matrix.cells.join(asked.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", "score", F.lit(1)))
    better = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id", "stored").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("user_id").orderBy("item_id", "stored").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("ahead", F.sum("stored").over(better)).withColumn("smaller", F.sum("stored").over(before)).where("stored = 0")
    return _ranks(matrix, counted.select("user_id", "item_id", "score", "ahead", "smaller"))


def ranks_of_places(matrix: Completed, asked: DataFrame, counts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``completed_ranks`` of stored cells (user_id, item_id, score), each once, from ``counts``, which is that of ``Views.place_counts``."""
    x = micro(F.col("score"))
    rows = asked.join(matrix.rows.select("user_id", "fill"), "user_id").join(matrix.items.select("item_id"), "item_id", "left_semi")
    rows = kept(rows.select("user_id", "item_id", x.alias("x"), (F.col("score") == F.col("fill")).alias("by_id")))
    found = counts(rows)
    return _ranks(matrix, found.select("user_id", "item_id", (F.col("x") / 1e6).alias("score"), (F.col("above") + F.col("tied_before")).alias("ahead"), "smaller"))


def _ranks(matrix: Completed, counted: DataFrame) -> DataFrame:
    found = counted.join(matrix.rows.drop("number"), "user_id").join(matrix.items, "item_id").join(F.broadcast(matrix.shape), F.lit(True))
    default = F.when(F.col("fill") > F.col("score"), F.col("n") - F.col("n_cells")).when(F.col("fill") == F.col("score"), F.col("number") - F.col("smaller")).otherwise(0)
    rank = F.when(F.col("fill").isNotNull(), 1 + F.col("ahead") + default).otherwise(F.col("n") - (F.col("place") + F.col("turn")) % F.col("n"))
    return found.select("user_id", "item_id", "score", rank.cast("long").alias("rank"))


def completed_item_means(matrix: Completed, users: DataFrame) -> DataFrame:
    """Mean values of each item over the users of both groups: (item_id, mean_true, mean_false).

    ``users`` has (user_id, sensitive boolean). A column's sum is that of all defaults and of what the stored cells
    are above them. Made-up rows are left out: they say nothing of a group. A group without users gives null.
    """
    rows = matrix.rows.where("fill IS NOT NULL").select("user_id", "fill").join(users.select("user_id", "sensitive"), "user_id")
    groups = {"true": F.col("sensitive"), "false": ~F.col("sensitive")}
    totals = rows.agg(*[F.count(F.when(g, 1)).alias(f"n_{x}") for x, g in groups.items()], *[F.sum(F.when(g, F.col("fill"))).alias(f"all_{x}") for x, g in groups.items()])
    above = F.col("score") - F.col("fill")
    sums = matrix.cells.join(rows, "user_id").groupBy("item_id").agg(*[F.sum(F.when(g, above)).alias(f"above_{x}") for x, g in groups.items()])
    found = matrix.items.select("item_id").join(sums, "item_id", "left").join(F.broadcast(totals), F.lit(True))
    return found.select("item_id", *[F.try_divide(F.col(f"all_{x}") + F.coalesce(f"above_{x}", F.lit(0.0)), F.col(f"n_{x}")).alias(f"mean_{x}") for x in groups])


def item_means_of_sums(matrix: Completed, users: DataFrame, scores: DataFrame, fills: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``completed_item_means`` from sums: ``scores`` as ``Views.score_sums`` by ``sensitive``, ``fills`` as ``Views.value_sums``. Sums are whole millionths, so they are exact."""
    rows = matrix.rows.where("fill IS NOT NULL").join(users.select("user_id", "sensitive"), "user_id")
    rows = kept(rows.select("user_id", F.col("sensitive").cast("int").alias("grp"), micro(F.col("fill")).alias("value")))
    totals = rows.groupBy("grp").agg(F.count("*").alias("size"), F.sum("value").alias("all"))
    above = scores.select("item_id", "grp", (F.col("total") + CENTRE * 1_000_000 * F.col("n")).alias("v")).union(fills(rows).select("item_id", "grp", -F.col("value")))
    cells = above.groupBy("item_id", "grp").agg(exact("v").alias("v"))
    every = matrix.items.select("item_id").join(F.broadcast(totals), F.lit(True), "left").join(cells, ["item_id", "grp"], "left")
    mean = (F.col("all") + F.coalesce("v", F.lit(0))).cast("double") / F.col("size") / 1e6
    return every.groupBy("item_id").agg(*[F.max(F.when(F.col("grp") == g, mean)).alias(f"mean_{x}") for x, g in (("true", 1), ("false", 0))])
