import random

import pytest

from evenkeel.llm import binary_search as B


def code(v):
    return sum(1 << i for i in range(64) if i < len(v) and v[i] is not None and v[i] > 0)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    hot = [rng.gauss(0, 1) for _ in range(64)]
    rows += [(1000 + i, hot) for i in range(150)]  # one code holds a third of all rows
    rows += [(2000, None), (None, hot), (2001, [1.0, None, -1.0]), (2002, []), (7, rows[7][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("segments", [None, 3, 5])
def test_exact_against_brute_force(spark, vectors, segments):
    rows, df = vectors
    known = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    asked = df.where("vec_id % 100 = 0")
    got = {}
    for r in B.top_k(df, asked, k=5, sample_size=16, segments=segments).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["vec_id"]))
    want = {}
    for q in {(i, c) for i, c in known if i % 100 == 0}:
        near = sorted(((q[1] ^ c).bit_count(), i) for i, c in known)[:5]
        want[q[0]] = [(k + 1, d, i) for k, (d, i) in enumerate(near)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_few_rows_and_none(spark, vectors):
    _, df = vectors
    few = df.where("vec_id < 3")
    assert B.top_k(few, few, k=5).count() == 9
    assert B.top_k(df.limit(0), df.limit(0), k=5).count() == 0


def test_width_follows_the_number_of_codes():
    assert [B.segments_for(n) for n in (0, 5000, 10**6, 10**9, 10**12)] == [8, 5, 3, 3, 3]
    assert B.cut(3) == [(0, 21), (21, 21), (42, 22)]


def test_clashing_columns(spark, vectors):
    from pyspark.sql import functions as F

    _, df = vectors
    few = df.where("vec_id < 30")
    more = few.select("*", *[F.lit("x").alias(n) for n in ("id", "code", "n", "q", "bound", "query_id", "rank", "distance", "j", "key")])
    assert sorted(map(str, B.top_k(more, more, k=3).collect())) == sorted(map(str, B.top_k(few, few, k=3).collect()))
