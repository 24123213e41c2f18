"""Light baseline recommenders as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evenkeel.functions.scalars import dot, safe_sigmoid, six_places  # noqa: F401
from evenkeel.operators.numbering import kept, numbered
from evenkeel.operators.prepare import partner_sums


def biases(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mean rating (one row, ``mu``), and the mean deviations of items (``bi``) and users (``bu``)."""
    mean = train.agg(F.avg("rating").alias("mu"))
    off = train.join(F.broadcast(mean), F.lit(True)).withColumn("off", F.col("rating") - F.col("mu"))
    return mean, off.groupBy("item_id").agg(F.avg("off").alias("bi")), off.groupBy("user_id").agg(F.avg("off").alias("bu"))


def bias_scores(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores (user_id, item_id, score) of the pairs by mean plus biases; unknown ids have bias 0."""
    mean, items, users = biases(train)
    scored = pairs.join(items, "item_id", "left").join(users, "user_id", "left").join(F.broadcast(mean), F.lit(True))
    score = six_places(F.col("mu") + F.coalesce("bi", F.lit(0.0)) + F.coalesce("bu", F.lit(0.0)))
    return scored.select("user_id", "item_id", score.alias("score"))


def popularity_scores(train: DataFrame) -> DataFrame:
    """Items ranked by their interactions: (item_id, n, rank), ties by id."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("n"))
    return numbered(counts, [F.desc("n"), F.col("item_id")], "rank", start=1).withColumn("rank", F.col("rank").cast("int"))


def stratified_popularity(train: DataFrame, users: DataFrame, *strata: str, weight: str | None = None) -> DataFrame:
    """Share of each item among the interactions of its stratum (gender, age or both), or among the sums of ``weight``."""
    counts = train.join(users, "user_id").groupBy(*strata, "item_id").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*strata)))


def stratified_scores(pairs: DataFrame, users: DataFrame, shares: DataFrame, *strata: str) -> DataFrame:
    """Scores of pairs by the stratum of the user; unknown users give no row, unknown items 0."""
    known = pairs.join(users.select("user_id", *strata), "user_id")
    return known.join(shares.select(*strata, "item_id", "share"), [*strata, "item_id"], "left").select("user_id", "item_id", F.coalesce("share", F.lit(0.0)).alias("score"))


def item_neighbours(train: DataFrame, k: int) -> DataFrame:
    """The ``k`` items most similar by cosine of their rating vectors: (item_id, other_id, similarity, rank).

    Sums and ranks are made where an item's partners come together.
    """
    norms = train.groupBy("item_id").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))
    unit = train.join(norms, "item_id").select("user_id", "item_id", (F.col("rating") / F.col("norm")).alias("w"))
    similar = partner_sums(unit, "user_id", "item_id", "w").select(F.col("i1").alias("item_id"), F.col("i2").alias("other_id"), F.round("g", 6).alias("similarity"))
    order = Window.partitionBy("item_id").orderBy(F.desc("similarity"), "other_id")
    return similar.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_knn_scores(train: DataFrame, pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Scores of pairs: the similarity-weighted mean rating of the user's neighbouring items; null without any."""
    rated = train.select("user_id", F.col("item_id").alias("other_id"), "rating")
    rows = pairs.join(neighbours, "item_id").join(rated, ["user_id", "other_id"])
    return rows.groupBy("user_id", "item_id").agg((F.sum(F.col("similarity") * F.col("rating")) / F.sum(F.abs("similarity"))).alias("score"))


def log_counts(counts: DataFrame, value: str) -> DataFrame:
    """Adds log10 of counts and the inverse."""
    return counts.withColumn("logged", F.log10(value)).withColumn("back", F.pow(F.lit(10.0), F.col("logged")))


def degree_vector(edges: DataFrame, node: str) -> DataFrame:
    """1 / (degree + 1) of each node."""
    return edges.groupBy(node).agg((1 / (F.count("*") + 1)).alias("weight"))


def graph_convolution(edges: DataFrame, vectors: DataFrame, to: str, of: str, weight: Column) -> DataFrame:
    """One propagation step: for each node ``to`` the weighted sum of its neighbours' vectors.

    ``vectors`` has (``of``, vector array). They are shuffled once, as they are stored, and summed as doubles by position.
    """
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = edges.join(vectors, of).where(F.size("vector") > 0).select(to, weight.alias("w"), "vector").repartition(to)
    cells = [F.sum(F.col("w") * F.get("vector", F.lit(i)).cast("double")) for i in range(width)]
    # Vectors of fewer elements than the longest leave nothing behind their last.
    longest = F.max(F.size("vector")).alias("_n")
    return rows.groupBy(to).agg(F.array(*cells).alias("vector"), longest).select(to, F.slice("vector", F.lit(1), F.col("_n")).alias("vector"))


def dot_product_top_k(queries: DataFrame, items: DataFrame, k: int, query_blocks: int = 4, item_blocks: int | None = None) -> DataFrame:
    """Exact top k items of each query by dot product: (query_id, item_id, score, rank).

    The queries are a stated set against all items, in blocks: each pair of a block of queries and one
    of items is a join key. A block gives its own top k of a query, from which the top k of all come.
    """
    item_blocks = item_blocks or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("_a"), every(item_blocks).alias("_b"))
    right = items.select("item_id", "v", every(query_blocks).alias("_a"), F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).alias("_b"))
    scored = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(_block_best(k), "query_id long, item_id long, _b long, score double")
    scored = scored.withColumn("score", F.round("score", 5))
    order = [F.desc("score"), F.col("item_id")]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_b").orderBy(*order))).where(F.col("rank") <= k).drop("_b")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _block_best(k: int, margin: float = 2e-5, cells: int = 4_000_000):
    """The rows of a block of queries and one of items that can be among a query's ``k`` best when scores are rounded to 5 places.

    A matrix product finds them; their scores are then added up element by element. A missing
    vector, element or length gives no score, as in SQL, and comes last.
    """
    import numpy as np
    import pandas as pd

    def matrix(vectors, width: int) -> np.ndarray:
        good = [np.asarray(v, float) if v is not None and len(v) == width else np.full(width, np.nan) for v in vectors]
        return np.stack(good) if good else np.empty((0, width))

    def best(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(items):
            width = max((len(v) for c in (queries["q"], items["v"]) for v in c if v is not None), default=0)
            q, v = matrix(queries["q"], width), matrix(items["v"], width)
            step = max(1, cells // len(v))
            for low in range(0, len(q), step):
                near = q[low : low + step] @ v.T
                near[np.isnan(near)] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if len(v) > k else np.full(len(near), -np.inf)
                at, to = np.nonzero(near >= least[:, None] - margin)
                score = np.zeros(len(at))
                for d in range(width):
                    score += q[low + at, d] * v[to, d]
                out.append(pd.DataFrame({"query_id": queries["query_id"].to_numpy()[low + at], "item_id": items["item_id"].to_numpy()[to], "_b": items["_b"].to_numpy()[to], "score": pd.array(score, "Float64")}))
                out[-1].loc[np.isnan(score), "score"] = pd.NA
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "item_id": [], "_b": [], "score": []})

    return best


def als_step(ratings: DataFrame, fixed: DataFrame, solve_for: str, given: str, rank: int, ridge: float) -> DataFrame:
    """One exact alternating-least-squares half step: ``(solve_for, vector)``.

    The normal equations are sums of outer products, aggregated before each small system is solved
    in an Arrow batch.
    """
    import numpy as np
    import pandas as pd

    size = rank * rank + rank
    rows = ratings.join(fixed.select(given, "vector"), given)
    cells = F.array(*[F.get("vector", F.lit(i)) * F.get("vector", F.lit(j)) for i in range(rank) for j in range(rank)], *[F.get("vector", F.lit(i)) * F.col("rating") for i in range(rank)])
    sums = rows.select(solve_for, cells.alias("c")).groupBy(solve_for).agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(size)]).alias("sums"))

    def solved(batches):
        for batch in batches:
            out = []
            for s in batch:
                s = np.asarray(s)
                out.append(np.linalg.solve(s[: rank * rank].reshape(rank, rank) + ridge * np.eye(rank), s[rank * rank :]).tolist())
            yield pd.Series(out)

    from collections.abc import Iterator

    solved.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return sums.select(solve_for, F.pandas_udf(solved, "array<double>")("sums").alias("vector"))


def user_neighbours(train: DataFrame, k: int) -> DataFrame:
    """The ``k`` users most similar by cosine of their rating vectors: (user_id, other_id, similarity, rank).

    Items that many users rated are cut into blocks like the profiles of ``item_neighbours``.
    """
    turned = train.select(F.col("item_id").alias("user_id"), F.col("user_id").alias("item_id"), "rating")
    return item_neighbours(turned, k).withColumnRenamed("item_id", "user_id")


def user_knn_scores(train: DataFrame, pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Scores of pairs: the user's mean and the similarity-weighted mean of how far neighbours rated the item off their own means."""
    means = train.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    off = train.join(means, "user_id").select(F.col("user_id").alias("other_id"), "item_id", (F.col("rating") - F.col("mean")).alias("off"))
    rows = pairs.join(neighbours, "user_id").join(off, ["other_id", "item_id"]).groupBy("user_id", "item_id")
    moved = rows.agg((F.sum(F.col("similarity") * F.col("off")) / F.sum(F.abs("similarity"))).alias("moved"))
    return moved.join(means, "user_id").select("user_id", "item_id", (F.col("mean") + F.col("moved")).alias("score"))


def feature_step(errors: DataFrame, fixed: DataFrame, solve_for: str, given: str, penalty: float) -> DataFrame:
    """One feature's values (solve_for, x) from the others' (given, x) and ``errors`` (user_id, item_id, e), by ridge regression."""
    rows = errors.join(fixed.withColumnRenamed("x", "_x"), given)
    return rows.groupBy(solve_for).agg((F.sum(F.col("e") * F.col("_x")) / (F.sum(F.col("_x") * F.col("_x")) + penalty)).alias("x"))


def fit_features(train: DataFrame, features: int, penalty: float, rounds: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features one after the other, each on the errors that the ones before leave: users and items (id, values), and the errors.

    The errors begin as those of the bias model. A feature's users and items are solved in turn ``rounds``
    times; then it stays, and its products come off the errors, which are written for the next.
    """
    mean, by_item, by_user = biases(train)
    scored = train.join(by_item, "item_id").join(by_user, "user_id").join(F.broadcast(mean), F.lit(True))
    errors = kept(scored.select("user_id", "item_id", (F.col("rating") - six_places(F.col("mu") + F.col("bi") + F.col("bu"))).alias("e")))
    nothing = F.array().cast("array<double>")
    users, items = (errors.select(c).distinct().withColumn("values", nothing) for c in ("user_id", "item_id"))
    for f in range(features):
        own = errors.select("user_id").distinct().select("user_id", (0.1 + F.pmod(F.col("user_id") * 7919 + f * 104729, F.lit(1009)) / 1009.0).alias("x"))
        for _ in range(rounds):
            theirs = kept(feature_step(errors, own, "item_id", "user_id", penalty))
            own = kept(feature_step(errors, theirs, "user_id", "item_id", penalty))
        errors = kept(errors.join(own, "user_id").join(theirs.withColumnRenamed("x", "_x"), "item_id").select("user_id", "item_id", (F.col("e") - F.col("x") * F.col("_x")).alias("e")))
        users, items = (kept(t.join(x, c).select(c, F.concat("values", F.array("x")).alias("values"))) for t, x, c in ((users, own, "user_id"), (items, theirs, "item_id")))
    return users, items, errors
