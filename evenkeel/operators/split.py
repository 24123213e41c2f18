"""Splits of interaction logs. All are deterministic: orders end in a unique key or a hash of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = "part"


def part_sizes(n: int, shares: list[float]) -> list[int]:
    """Row counts of shares of ``n`` rows, rounded; what is left over goes to the last part."""
    sizes = [round(s * n) for s in shares[:-1]]
    return [*sizes, n - sum(sizes)]


def hash_order(*keys: str, seed: int = 0) -> list[Column]:
    """A pseudo-random order that is the same in every run: a modular hash, then the keys."""
    mixed = F.lit(seed).cast("long")
    for k, prime in zip(keys, (7919, 104729, 1299709)):
        mixed = mixed + F.col(k) * prime
    return [F.pmod(mixed, F.lit(1000003)), *[F.col(k) for k in keys]]


def per_user_timestamp_split(rows: DataFrame, user: str, order: list[str | Column], val: float, test: float) -> DataFrame:
    """Adds ``part``: per user train, then val, then test in the given order.

    Parts take ``floor(n * share)`` rows in double arithmetic; rows left over go to train.
    """
    w = Window.partitionBy(user)
    n = F.count("*").over(w)
    out = rows.withColumns({"_rank": F.row_number().over(w.orderBy(*order)), "_n": n})
    n_val, n_test = F.floor(F.col("_n") * F.lit(val)), F.floor(F.col("_n") * F.lit(test))
    part = F.when(F.col("_rank") <= F.col("_n") - n_val - n_test, "train").when(F.col("_rank") <= F.col("_n") - n_test, "val").otherwise("test")
    return out.withColumn(PART, part).drop("_rank", "_n")


def per_user_random_split(rows: DataFrame, user: str, item: str, val: float, test: float, seed: int = 0) -> DataFrame:
    """As the timestamp split, in hash order."""
    return per_user_timestamp_split(rows, user, hash_order(user, item, seed=seed), val, test)


def random_split(rows: DataFrame, keys: list[str], shares: dict[str, float], total: int, seed: int = 0) -> DataFrame:
    """Adds ``part`` by position in hash order; shares are counts rounded over ``total`` rows.

    Positions within hash ranges come from counts of the ranges before, so no task sorts all rows.
    """
    placed = positions(rows, keys, seed, ranges_for(total))
    sizes, out, start = part_sizes(total, list(shares.values())), F.lit(None).cast("string"), 0
    for name, size in zip(shares, sizes):
        out = F.when((F.col("position") >= start) & (F.col("position") < start + size), name).otherwise(out)
        start += size
    return placed.withColumn(PART, out).drop("position")


def ranges_for(total: int, rows: int = 100_000) -> int:
    """Hash ranges of about so many rows; the hash has a million values."""
    return min(1000003, max(64, total // rows))


def positions(rows: DataFrame, keys: list[str], seed: int = 0, ranges: int = 64) -> DataFrame:
    """Adds ``position`` (from 0) in hash order: rank within a hash range plus the ranges before it."""
    order = hash_order(*keys, seed=seed)
    ranged = rows.withColumn("_range", F.floor(order[0] * ranges / 1000003).cast("int"))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # At most ``ranges`` rows.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    placed = ranged.join(F.broadcast(before), "_range")
    return placed.withColumn("position", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).drop("_range", "_before")


def shares_of(split: list) -> list[float | int | None]:
    """Parts as percent strings ("70%"), shares (floats), counts (integers) or None, all of one kind, as numbers."""
    given = [x for x in split if x is not None]
    if not given:
        raise ValueError("all parts are None")
    kinds = {type(x) for x in given}
    if len(kinds) > 1 or len(split) not in (2, 3):
        raise ValueError("two or three parts of one kind")
    if kinds == {str}:
        if not all(x.endswith("%") for x in given):
            raise ValueError("parts given as text need a %")
        return [None if x is None else float(x[:-1]) / 100 for x in split]
    return list(split)


def train_test(rows: DataFrame, split: list, kind: str = "per_user_timestamp", user: str = "user_id", item: str = "item_id", time: str = "ts", seed: int = 0, folds: int = 5) -> DataFrame:
    """Adds ``part`` (train, val, test) by one of the ways to split.

    ``split`` gives train and test, or train, val and test. ``random`` takes percents, shares or counts
    of all rows; ``per_user_timestamp`` and ``per_user_random`` percents or shares of each user's;
    a part that is None gets the rest. ``k_fold`` adds ``fold`` instead: rows of fold f are test in
    round f, the others train.
    """
    if kind == "k_fold":
        return k_fold(rows, [user, item], folds, rows.count(), seed)
    given = shares_of(split)
    train, val, test = given if len(given) == 3 else (given[0], 0 if isinstance(given[0], int) else 0.0, given[1])
    if kind == "random":
        n = rows.count()
        whole = n if any(isinstance(x, int) and x for x in given) else 1.0
        known = sum(x for x in (train, val, test) if x is not None)
        train, val, test = (whole - known if x is None else x for x in (train, val, test))
        return random_split(rows, [user, item], {"train": train / whole, "val": val / whole, "test": test / whole}, n, seed)
    if kind not in ("per_user_timestamp", "per_user_random"):
        raise ValueError(f"no split of kind {kind}")
    if any(isinstance(x, int) and x for x in given):
        raise ValueError("parts of each user are shares")
    val, test = val if val is not None else 1 - train - test, test if test is not None else 1 - train - (val or 0.0)
    if kind == "per_user_timestamp":
        return per_user_timestamp_split(rows, user, [time, item], val, test)
    return per_user_random_split(rows, user, item, val, test, seed)


def k_fold(rows: DataFrame, keys: list[str], folds: int, total: int, seed: int = 0) -> DataFrame:
    """Adds ``fold`` by position in hash order; trailing rows beyond ``folds * floor(n / folds)`` get null: they are tested in no fold."""
    size = total // folds
    fold = F.floor(F.col("position") / size).cast("int")
    return positions(rows, keys, seed, ranges_for(total)).withColumn("fold", F.when(F.col("position") < size * folds, fold)).drop("position")


def k_fold_within_groups(rows: DataFrame, group: str, order: list[str], folds: int) -> DataFrame:
    """Adds ``fold`` (from 0) of contiguous blocks within each group; the first groups of blocks get one row more."""
    return rows.withColumn("fold", F.ntile(folds).over(Window.partitionBy(group).orderBy(*order)) - 1)


def interlaced_k_fold(rows: DataFrame, user: str, order: list[str], folds: int) -> DataFrame:
    """Adds ``fold``: row i of each user goes to fold i mod ``folds``."""
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy(user).orderBy(*order)) - 1) % folds)


def shuffle_split_within_groups(rows: DataFrame, group: str, keys: list[str], test: float, seed: int = 0) -> DataFrame:
    """Adds ``part``: in hash order the first ``ceil(n * test)`` rows of each group are test."""
    w = Window.partitionBy(group)
    first = F.row_number().over(w.orderBy(*hash_order(*keys, seed=seed))) <= F.ceil(F.count("*").over(w) * F.lit(test))
    return rows.withColumn(PART, F.when(first, "test").otherwise("train"))


def leave_out_by_time(rows: DataFrame, user: str, order: list[str], leave: int, warm: int) -> DataFrame:
    """Adds ``part``: the first ``warm`` rows of a user always train; of the rest the last ``leave`` are test and the ``leave`` before them val."""
    w = Window.partitionBy(user)
    out = rows.withColumns({"_asc": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    back = F.col("_n") - F.col("_asc")
    part = F.when(F.col("_asc") <= warm, "train").when(back < leave, "test").when(back < 2 * leave, "val").otherwise("train")
    return out.withColumn(PART, part).drop("_asc", "_n")


def leave_out_positives(rows: DataFrame, user: str, order: list[str], label: str, leave: int) -> DataFrame:
    """Adds ``part`` for 0/1 labels: the last ``leave`` positives of a user, with all rows after the first of them, are test.

    Positives are counted from the end by a running sum; users with fewer positives keep all in train.
    """
    w = Window.partitionBy(user)
    ahead = F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).over(w.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumns({"_ahead": F.coalesce(ahead, F.lit(0)), "_all": F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).over(w)})
    test = (F.col("_all") >= leave) & (F.col("_ahead") < leave)
    return out.withColumn(PART, F.when(test, "test").otherwise("train")).drop("_ahead", "_all")


def holdout_per_user(rows: DataFrame, user: str, item: str, holdout: int, min_rows: int, partitions: int, seed: int = 0) -> DataFrame:
    """A crossfold by users: adds ``fold`` (1 to ``partitions``, null for users under ``min_rows``) and ``held`` for the held-out rows."""
    w = Window.partitionBy(user)
    out = rows.withColumns({"_n": F.count("*").over(w), "_rank": F.row_number().over(w.orderBy(*hash_order(user, item, seed=seed)))})
    enough = F.col("_n") >= min_rows
    fold = F.when(enough, (F.pmod(F.col(user) * 7919 + seed, F.lit(1000003)) % partitions + 1).cast("int"))
    return out.withColumns({"fold": fold, "held": enough & (F.col("_rank") <= holdout)}).drop("_n", "_rank")


def validation_mask(rows: DataFrame, user: str, item: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``masked``: ``bround(share * n)`` rows of each user in hash order."""
    w = Window.partitionBy(user)
    first = F.row_number().over(w.orderBy(*hash_order(user, item, seed=seed))) <= F.bround(F.count("*").over(w) * F.lit(share))
    return rows.withColumn("masked", first)
