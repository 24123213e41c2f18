"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path


def _written(df: DataFrame, paths: list[str]) -> DataFrame:
    spark, path = df.sparkSession, new_path(df.sparkSession, "stars")
    df.write.parquet(path)
    paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller neighbours and to itself."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Maps every node of ``edges`` (a long, b long, a <> b) to the smallest node it reaches.

    Returns ``node long, root long``. Edges stay as many or get fewer in each round; their table is
    written in the shared folder after each round, so lineage stays short and lost executors cost
    one round. The rounds end when the edges no longer change (logarithmic in the component size);
    more than ``max_rounds`` raise an error. Empty edges give an empty table.
    """
    spark, paths = edges.sparkSession, []
    marks = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    now = _written(edges.select("a", "b").distinct(), paths)
    seen = None
    for _ in range(max_rounds):
        now = _written(_small_star(_large_star(now)), paths)
        mark = tuple(now.agg(*marks).first())
        for old in paths[:-2]:
            drop_path(spark, old)
        paths[:] = paths[-2:]
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
