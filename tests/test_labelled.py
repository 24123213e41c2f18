"""Labelled files: rows are read once for all parts, and only those that can have a variable are joined."""

import random

from pyspark.sql import functions as F

from evenkeel.catalog import QUERIES
from evenkeel.sources import datasets as D
from evenkeel.sources import sinks
from evenkeel.sources.views import Views


def test_parts_are_written_in_one_pass(spark):
    folder, seen = D.scratch(spark, "labelled"), spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(u, i, float(i), "train" if i < 4 else "test" if i < 6 else None) for u in range(9) for i in range(7)], "user_id long, item_id long, rating double, part string")
    sinks.write_labelled(rows.mapInArrow(count, rows.schema), "part", ("train", "val", "test"), folder)
    assert seen.value == 63 and D.splits_of(spark, folder) == ["test", "train", "val"]
    got = {n: sorted(map(tuple, t.collect())) for n, t in D.read_labelled_folder(spark, folder).items()}
    assert got == {"train": [(u, i, 0) for u in range(9) for i in range(4)], "val": [], "test": [(u, i, 1) for u in range(9) for i in (4, 5)]}


def test_variables_are_joined_to_train_rows_alone(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    lines = [(n, draw.randint(1, 9), draw.randint(1, 300), float(draw.randint(1, 50))) for n in range(400)]
    spark.createDataFrame([(n, u) for n, u, _, _ in lines], "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.timestamp_seconds(F.col("o_orderkey") * 7919 % 1009)).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(n, i, q) for n, _, i, q in lines], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = Views(spark, str(tmp_path)).parts.collect()
    joined, real = [], D.with_variables
    monkeypatch.setattr(D, "with_variables", lambda rows, variables: joined.append(rows.count()) or real(rows, variables))
    got = QUERIES["S15_S32_K6_labelled_files"](spark, str(tmp_path))
    assert got.columns == ["uid", "iid", "label", "part", "variable", "n_variables"]
    most = max(r["item_id"] % 50 for r in want if r["part"] == "train") + 1
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r["user_id"], r["item_id"], int(r["rating"] > 3), r["part"], r["item_id"] % 50 if r["part"] == "train" else None, most)) for r in want)
    assert joined == [sum(r["part"] == "train" for r in want)]
