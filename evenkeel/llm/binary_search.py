"""Exact top-k search of binary codes by incremental multi-index hashing.

A code of 64 bits is cut into ``segments`` of nearly equal width, each with an index of its own. If
all codes that have a segment within radius r of the query's are known, every code within Hamming
distance ``segments * (r + 1) - 1`` is known. The radius grows from 0 until the k-th verified distance
of a query is that small; then its result is provably complete and it takes no further part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_path, materialize, new_path, ship

BITS = 64


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The code of a vector: bit i is set if element i is positive. Null vectors give null; missing elements count as not positive."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        weight = (1 << i) if i < 63 else -(1 << 63)
        code = code + F.when(F.get(vector, F.lit(i)) > 0, F.lit(weight).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(vector.isNotNull(), code)


def cut(segments: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most."""
    ends = [i * bits // segments for i in range(segments + 1)]
    return [(lo, hi - lo) for lo, hi in zip(ends, ends[1:])]


def segments_for(n: int) -> int:
    """As many segments as make one about as wide as the logarithm of the number of codes.

    Then a bucket holds about one code. At least 3, so that one radius has at most C(22, 11) =
    705,432 masks, and at most 8.
    """
    return min(8, max(3, round(BITS / max(1.0, math.log2(max(2, n))))))


def _segment(code: Column, part: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(code, part[0]).bitwiseAND((1 << part[1]) - 1)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bounds(sample: np.ndarray, k: int):
    """Upper bounds of the k-th distance, from a sample of at least k codes."""

    def bound(codes: pd.Series) -> pd.Series:
        own = codes.to_numpy(np.int64).view(np.uint64)
        out = np.empty(len(own), np.int64)
        for at in range(0, len(own), 512):
            near = np.bitwise_count(own[at : at + 512, None] ^ sample[None, :])
            out[at : at + 512] = np.partition(near, k - 1, axis=1)[:, k - 1]
        return pd.Series(out)

    return F.pandas_udf(bound, "int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None, sample_size: int = 2048, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each query by Hamming distance of sign codes, exactly.

    Returns ``query_id, rank int (from 1), id_column, distance int``; ties are ordered by id. A row
    may be its own neighbour if it is among the queries. With fewer than k rows all are returned.

    Equal codes are one entry of the index, with the k smallest ids (more can't be needed). A first
    bound of each query's k-th distance comes from ``sample_size`` codes; the joins verify distances
    against it, so they pass on few candidates, and it sinks with every round. A candidate is passed
    on in the first round and segment that finds it, so none comes twice. The number of segments
    follows from the number of different codes unless it is given; results don't depend on it.

    Rows and queries without id or vector are left out. Repeated query rows give one result;
    repeated rows of ``vectors`` count as often as they occur. Empty tables give empty results.
    """
    spark = vectors.sparkSession
    ship(spark)
    codes = vectors.select(F.col(id_column).alias("id"), sign_code(F.col(vector_column)).alias("code")).where("id is not null and code is not null")
    first = Window.partitionBy("code").orderBy("id")
    copies = materialize(codes.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("code", "id", "n"), "codes")
    index = copies.where("n = 1").select("code")
    parts = cut(segments or segments_for(index.count()))
    segments, width = len(parts), max(w for _, w in parts)
    sample = np.array([r["code"] for r in copies.orderBy(F.xxhash64("id", "n"), "id", "n").select("code").limit(max(sample_size, k)).collect()], np.int64).view(np.uint64)
    asked = queries.select(F.col(id_column).alias("query_id"), sign_code(F.col(vector_column)).alias("q")).where("query_id is not null and q is not null").distinct()
    bound = _bounds(sample, k)("q") if len(sample) >= k else F.lit(BITS)
    asked = materialize(asked.withColumn("bound", bound), "queries")
    keyed = index.select("code", F.posexplode(F.array(*[_segment(F.col("code"), p) for p in parts])).alias("j", "key"))
    keyed = materialize(keyed, "segment-index")
    paths, found, active = [], None, asked
    for radius in range(width + 1):
        masks = spark.range(1 << width).where(F.bit_count("id") == radius).select(F.col("id").alias("flip"))
        probes = active.select("query_id", "q", "bound", F.posexplode(F.array(*[_segment(F.col("q"), p) for p in parts])).alias("j", "own"))
        # At most 705,432 masks however many rows there are; those beyond a narrower segment are left out.
        fits = F.col("flip") < F.element_at(F.array(*[F.lit(1 << w).cast("long") for _, w in parts]), F.col("j") + 1)
        probes = probes.join(F.broadcast(masks)).where(fits).select("query_id", "q", "bound", "j", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
        near = [F.bit_count(_segment(F.col("q").bitwiseXOR(F.col("code")), p)) for p in parts]
        here = F.col("j")
        new = F.lit(True)
        for i in range(segments):
            # Found in no smaller radius, and at this radius in no segment before.
            new = new & F.when(here > i, near[i] > radius).otherwise(near[i] >= radius)
        hits = probes.join(keyed, ["j", "key"]).where((_distance("q", "code") <= F.col("bound")) & new).select("query_id", "q", "code", _distance("q", "code").alias("distance"))
        hits = hits.join(copies, "code").select("query_id", "id", "n", "distance")
        pool = hits if found is None else found.union(hits)
        ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id", "n"))).where(F.col("rank") <= k)
        path = new_path(spark, "nearest")
        ranked.select("query_id", "id", "n", "distance").write.parquet(path)
        paths.append(path)
        found = spark.read.schema("query_id long, id long, n int, distance int").parquet(path)
        kth = found.groupBy("query_id").agg(F.count("*").alias("have"), F.max("distance").alias("far"))
        proven = segments * (radius + 1) - 1
        state = asked.join(kth, "query_id", "left").withColumn("left", F.when((F.col("have") >= k) & (F.col("far") <= proven), False).otherwise(proven < F.col("bound")))
        active = materialize(state.where("left").select("query_id", "q", F.when(F.col("have") >= k, F.least("bound", "far")).otherwise(F.col("bound")).alias("bound")), "open-queries")
        for old in paths[:-2]:
            drop_path(spark, old)
        paths = paths[-2:]
        if active.isEmpty():
            break
    order = Window.partitionBy("query_id").orderBy("distance", "id", "n")
    return found.select("query_id", F.row_number().over(order).alias("rank"), F.col("id").alias(id_column), "distance")
