"""Numbering of rows in an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept(rows: DataFrame) -> DataFrame:
    """The rows as they come out once: checkpointed, or persisted where the session has no checkpoint folder."""
    context = rows.sparkSession.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    base = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not held.isDefined() and base:
        context.setCheckpointDir(base)
        held = context._jsc.sc().getCheckpointDir()
    return rows.checkpoint() if held.isDefined() else rows.persist()


def running(counts: DataFrame, x: str, sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """Adds running sums in the order of ``x``, and ``next``, the next value of ``x``, without one task for all rows.

    ``sums`` maps names to the columns to sum up to and with the row; ``x`` is numeric and no value
    comes twice. Quantiles of ``x`` cut the rows into ``ranges`` (the shuffle partitions unless given);
    a row's sum is that within its range plus the ranges before, a table of a row for each range.
    """
    ranges = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = counts.agg(F.percentile_approx(x, shares, 20 * ranges).alias("_bounds"))
    dealt = counts.join(F.broadcast(bounds), F.lit(True)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col(x)))).drop("_bounds")
    totals = dealt.groupBy("_range").agg(F.min(x).alias("_first"), *[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    order = Window.orderBy("_range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.lead("_first").over(order).alias("_after"), *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(x)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({f"_in_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {"_next": F.lead(x).over(inside)}).join(F.broadcast(totals), "_range")
    out = placed.withColumns({n: F.col(f"_before_{n}") + F.col(f"_in_{n}") for n in sums} | {"next": F.coalesce("_next", "_after")})
    return out.select(*counts.columns, *sums, "next")


def numbered(rows: DataFrame, order: list[str | Column], output: str, start: int = 0) -> DataFrame:
    """Adds ``output``: the place of each row in ``order``, which ends in a unique key, from ``start``.

    Rows are range-partitioned, sorted and numbered in place; the rows of the partitions before are
    added from a table with a row for each partition. So that both passes see the same partitions, the
    rows are checkpointed in the session's checkpoint folder; where none is set they are kept in the
    executors (computed again if lost).
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    spread = kept(spread)
    starts, total = [], start
    for p, n in sorted((r["_p"], r["count"]) for r in spread.groupBy("_p").count().collect()):
        starts.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    return spread.join(F.broadcast(offsets), "_p").withColumn(output, F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")
