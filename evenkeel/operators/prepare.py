"""Cleaning, filtering, recoding and id mapping of interaction logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions.scalars import age_bin, binarize, power_transform, score_bin  # noqa: F401

from .numbering import numbered
from .split import hash_order


def to_int(rows: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """String columns to integers where they are numbers, else null; ``skip`` stay."""
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` AS INT)") for c, t in rows.dtypes if t == "string" and c not in skip})


def at_least(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys with at least ``n`` rows. Counts are aggregated before they meet the rows."""
    enough = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(key)
    return rows.join(enough, key, "left_semi")


def over_counts(rows: DataFrame, user: str, item: str, n_user: int, n_item: int) -> DataFrame:
    """Users with more than ``n_user`` rows, then of these rows the items with more than ``n_item``, in one pass each."""
    return at_least(at_least(rows, user, n_user + 1), item, n_item + 1)


def balance_groups(rows: DataFrame, users: DataFrame, user: str, group: str, sizes: dict[object, int], seed: int = 0) -> DataFrame:
    """Rows of a fixed number of users of each group, chosen by a hash."""
    order = Window.partitionBy(group).orderBy(*hash_order(user, seed=seed))
    limit = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col(group)]
    chosen = users.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).select(user)
    return rows.join(chosen, user, "left_semi")


def balanced_sizes(size_a: int, size_b: int, ratio_a: float, ratio_b: float) -> tuple[int, int]:
    """The largest group sizes in the ratio a:b within what there is."""
    unit = min(size_a / ratio_a, size_b / ratio_b)
    return int(unit * ratio_a), int(unit * ratio_b)


def balance_groups_by_ratio(rows: DataFrame, users: DataFrame, user: str, group: str, ratio: dict[object, float], seed: int = 0) -> DataFrame:
    """Rows of as many users of each of two groups as the ratio allows, chosen by a hash."""
    (a, ra), (b, rb) = ratio.items()
    n = {r[group]: r["count"] for r in users.where(F.col(group).isin(a, b)).groupBy(group).count().collect()}
    sizes = balanced_sizes(n.get(a, 0), n.get(b, 0), ra, rb)
    return balance_groups(rows, users.where(F.col(group).isin(a, b)), user, group, {a: sizes[0], b: sizes[1]}, seed)


def drop_negatives(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a positive label, for training on these alone."""
    return rows.where(F.col(label) > 0)


def synthetic_ratings(spark: SparkSession, n_users: int, n_items: int, shares: dict[tuple[str, str], tuple[float, float]], seed: int = 0) -> DataFrame:
    """Made-up ratings: (user, user_type, item, item_type, gender, rating).

    Users and items take the types of ``shares`` in turn. A pair of types has a share of observed
    pairs and, of these, a share that is liked (rating 2, else 1). Users of types that begin with W are F.
    Choices are hashes; each user draws from the items, so the work is that of the result's full matrix.
    """
    user_types, item_types = sorted({a for a, _ in shares}), sorted({b for _, b in shares})
    users = spark.range(n_users).select(F.col("id").alias("user"), F.element_at(F.array(*[F.lit(t) for t in user_types]), (F.col("id") % len(user_types) + 1).cast("int")).alias("user_type"))
    pairs = users.withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_items - 1).cast("long"))))
    pairs = pairs.withColumn("item_type", F.element_at(F.array(*[F.lit(t) for t in item_types]), (F.col("item") % len(item_types) + 1).cast("int")))
    key = F.concat("user_type", F.lit("|"), "item_type")

    def chance(k: int):
        return F.create_map(*[F.lit(x) for (a, b), v in shares.items() for x in (f"{a}|{b}", float(v[k]))])[key]

    def dice(k: int):
        return F.pmod(F.xxhash64("user", "item", F.lit(seed), F.lit(k)), F.lit(1000000)) / 1000000.0

    seen = pairs.where(dice(0) < chance(0)).withColumn("rating", F.when(dice(1) < chance(1), 2.0).otherwise(1.0))
    return seen.select("user", "user_type", "item", "item_type", F.when(F.col("user_type").startswith("W"), "F").otherwise("M").alias("gender"), "rating")


def sample_values(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Rows of ``n`` distinct values of a key, chosen by a hash."""
    chosen = rows.select(key).distinct().orderBy(*hash_order(key, seed=seed)).limit(n)
    return rows.join(chosen, key, "left_semi")


def binary(column: str, delimiter: object) -> Column:
    """True for values up to the delimiter."""
    return F.col(column) <= F.lit(delimiter)


def min_max(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Adds ``scaled``: the column moved to [low, high]; ``low`` if all values are equal."""
    bounds = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), low + (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (high - low)).otherwise(F.lit(low))
    return rows.join(F.broadcast(bounds), F.lit(True)).withColumn("scaled", scaled).drop("_lo", "_hi")


def fit_power(rows: DataFrame, column: str, low: float = -2.0, high: float = 2.0, steps: int = 3, points: int = 9) -> float:
    """The Yeo-Johnson parameter of highest likelihood: a grid refined in ``steps`` aggregations."""
    best = 1.0
    for _ in range(steps):
        grid = [low + i * (high - low) / (points - 1) for i in range(points)]
        x = F.col(column).cast("double")
        tail = F.sum(F.signum(x) * F.log1p(F.abs(x)))
        row = rows.agg(F.count(x).alias("n"), tail.alias("tail"), *[F.var_pop(power_transform(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        import math

        scored = [(-row["n"] / 2 * math.log(max(row[f"v{i}"], 1e-300)) + (g - 1) * row["tail"], g) for i, g in enumerate(grid)]
        best = max(scored)[1]
        width = (high - low) / (points - 1)
        low, high = best - width, best + width
    return best


def dense_ids(rows: DataFrame, key: str, output: str) -> DataFrame:
    """Adds ids from 0 in the order of the key, by way of a table of the distinct keys."""
    keys = rows.select(key).distinct().where(F.col(key).isNotNull())
    return rows.join(numbered(keys, [key], output), key, "left")


def to_internal(rows: DataFrame, ids: DataFrame, key: str, n_objects: int, internal: str = "iid") -> DataFrame:
    """External to internal ids; unknown ones become ``n_objects``."""
    return rows.join(ids, key, "left").withColumn(internal, F.coalesce(F.col(internal), F.lit(n_objects)))


def first_per_pair(rows: DataFrame, user: str, item: str, order: list[str]) -> DataFrame:
    """The first row of each (user, item) in the given order."""
    w = Window.partitionBy(user, item).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def complement_pairs(users: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame:
    """All user x item pairs that aren't known. The result itself has that size."""
    return users.select("user_id").crossJoin(items.select("item_id")).join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def complement_sums(users: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame:
    """Of ``complement_pairs`` each user's number ``n`` of items and the sum ``id_sum`` of their ids, without the product; users who know all are left out."""
    met = known.join(items.select("item_id"), "item_id", "left_semi").select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count("*").alias("_n"), F.sum("item_id").alias("_ids"))
    every = items.agg(F.count("*").alias("_items"), F.sum("item_id").alias("_sum"))
    rows = users.select("user_id").join(met, "user_id", "left").join(F.broadcast(every), F.lit(True))
    out = rows.select("user_id", (F.col("_items") - F.coalesce("_n", F.lit(0))).alias("n"), (F.col("_sum") - F.coalesce("_ids", F.lit(0))).alias("id_sum"))
    return out.where("n > 0")


def profile_pairs(rows: DataFrame, user: str, item: str, weight: str | None = None, block: int = 1000) -> DataFrame:
    """All pairs (i1 < i2) of items in a user's profile, with ``w1`` and ``w2`` if there is a weight.

    Profiles of more than ``block`` rows are cut into blocks, and each pair of blocks is a join key of
    its own: no task has more than block * block pairs of a user to make.
    """
    sizes = rows.groupBy(user).agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("_blocks"))
    cut = rows.join(sizes, user).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    weights = [[F.col(weight).alias(f"w{k}")] if weight else [] for k in (1, 2)]
    left = cut.select(user, F.col(item).alias("i1"), *weights[0], F.col("_own").alias("_a"), other.alias("_b"))
    right = cut.select(user, F.col(item).alias("i2"), *weights[1], other.alias("_a"), F.col("_own").alias("_b"))
    return left.join(right, [user, "_a", "_b"]).where("i1 < i2").drop("_a", "_b")


def partner_sums(rows: DataFrame, user: str, item: str, weight: str | None = None, mirrored: bool = True, carried: str | None = None, block: int = 1000, per_task: int = 2_000_000) -> DataFrame:
    """For each item ``i1`` the items ``i2`` of its users' profiles, with ``g``, the sum of the products of weights, or the number of users.

    Each item of a profile gets the others as arrays, in one shuffle by ``i1``; sums by pair and orders or
    groupings by ``i1`` then need none. ``mirrored`` gives both orders of a pair, else ``i1 < i2``.
    ``carried`` is a value of each item that comes along as ``c1`` and ``c2``. Profiles are cut into arrays of about ``block`` items, and the number of tasks grows with that of pairs.
    """
    sizes = rows.groupBy(user).agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-pairs // (per_task * (1 if mirrored else 2))))
    cut = rows.join(sizes.select(user, F.ceil(F.col("n") / F.lit(block)).cast("long").alias("_b")), user).withColumn("_b", F.pmod(F.xxhash64(item), F.col("_b")))
    held = {"w": weight, "c": carried}
    held = {name: column for name, column in held.items() if column}
    lists = cut.groupBy(user, "_b").agg(F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), *[F.col(c).alias(name) for name, c in held.items()]))).alias("l"))
    lists = lists.select(user, *[F.col(f"l.{name}").alias(name) for name in ("i", *held)])
    met = rows.select(user, F.col(item).alias("i1"), *[F.col(c).alias(f"{name}1") for name, c in held.items()]).join(lists, user).drop(user)
    if not mirrored and not held:
        met = met.withColumn("i", F.filter("i", lambda x: x > F.col("i1"))).where(F.size("i") > 0)
    near = F.inline(F.arrays_zip("i", *held)).alias("i2", *[f"{name}2" for name in held]) if held else F.explode("i").alias("i2")
    each = met.repartition(int(tasks), "i1").select("i1", *[f"{name}1" for name in held], near).where("i1 <> i2" if mirrored else "i1 < i2")
    along = [F.first(f"c{i}").alias(f"c{i}") for i in (1, 2)] if carried else []
    return each.groupBy("i1", "i2").agg((F.sum(F.col("w1") * F.col("w2")) if weight else F.count("*")).alias("g"), *along)


def short_head(counts: DataFrame, share: float) -> DataFrame:
    """Adds ``short_head``: whether an item is among the most popular ``share`` of all, by rank."""
    ranked = numbered(counts, [F.desc("n"), F.col("item_id")], "rank", start=1)
    total = counts.agg(F.count("*").alias("items"))
    return ranked.join(F.broadcast(total), F.lit(True)).withColumn("short_head", F.col("rank") <= F.floor(F.col("items") * F.lit(share))).drop("items")


def offsets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_code``: the value plus the sizes (largest value + 1) of the columns before."""
    top = rows.agg(*[(F.max(c) + 1).alias(f"_{c}") for c in columns])
    out, base = rows.join(F.broadcast(top), F.lit(True)), F.lit(0)
    for c in columns:
        out = out.withColumn(f"{c}_code", F.col(c) + base)
        base = base + F.col(f"_{c}")
    return out.drop(*[f"_{c}" for c in columns])


def top_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` keys with the most rows, ties by key."""
    most = rows.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), key).limit(n).select(key)
    return rows.join(F.broadcast(most), key, "left_semi")


def observed(rows: DataFrame, user: str, item: str) -> DataFrame:
    """The sorted set of items of each user."""
    return rows.groupBy(user).agg(F.sort_array(F.collect_set(item)).alias("items"))


def histories(rows: DataFrame, user: str, item: str, order: list[str], length: int) -> DataFrame:
    """Adds ``history``: the up to ``length`` items of the user before each row."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(-length, -1)
    return rows.withColumn("history", F.collect_list(item).over(w))


def oversample_positives(rows: DataFrame, label: str) -> DataFrame:
    """Positives repeated floor(negatives / positives) times, if that is more than once."""
    counts = rows.agg(F.sum((F.col(label) > 0).cast("int")).alias("_p"), F.sum((F.col(label) <= 0).cast("int")).alias("_q"))
    times = F.when((F.col(label) > 0) & (F.col("_p") > 0), F.greatest(F.floor(F.col("_q") / F.col("_p")), F.lit(1))).otherwise(1)
    return rows.join(F.broadcast(counts), F.lit(True)).withColumn("_k", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_p", "_q", "_k")


def parse_history(text: Column) -> Column:
    """Comma-joined signed ints to an array."""
    return F.transform(F.split(text, ","), lambda x: x.cast("int"))


def pad(values: Column, size: Column) -> Column:
    """Zeros behind an array up to a size."""
    return F.concat(values, F.array_repeat(F.lit(0), F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def parse_dnf(sentence: Column) -> Column:
    """``1^~2v3`` to [[1, -2], [3]]: v is or, ^ is and, ~ negates."""
    return F.transform(F.split(sentence, "v"), lambda c: F.transform(F.split(c, r"\^"), lambda x: F.regexp_replace(x, "~", "-").cast("int")))


def dnf_holds(clauses: Column, truth: Column) -> Column:
    """Whether any clause has all its literals true; ``truth`` is an array of booleans by variable from 1."""
    return F.exists(clauses, lambda c: F.forall(c, lambda x: F.when(x > 0, F.element_at(truth, x)).otherwise(~F.element_at(truth, F.abs(x)))))
