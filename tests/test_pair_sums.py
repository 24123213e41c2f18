"""Sums over all scores without pairs, and the parts written once."""

import pytest
from pyspark.sql import functions as F

from evenkeel.plans import pair_sums
from test_shortlist import _folder


@pytest.mark.parametrize("block", [2000, 7])
def test_item_sums_are_those_of_all_pairs(spark, tmp_path, monkeypatch, block):
    v = _folder(spark, tmp_path, 80, 900, 30, (1, 2, 3, 4, 5))
    monkeypatch.setattr(pair_sums, "_CELLS", 50)
    profiles, items = v._biases()
    group, edges = (F.col("user_id") % 3).cast("int"), (2.5, 3.0)
    found = pair_sums.item_sums(profiles, items, group, 1000003, 20, edges, block)
    x = F.round(F.col("score") * 1e6).cast("long")
    bins = F.array(*[F.sum(c.cast("long")) for c in (x < 2500000, (x >= 2500000) & (x < 3000000), x >= 3000000)])
    pairs = v.predictions.groupBy("item_id", group.alias("grp"))
    true = pairs.agg(F.count("*").alias("n"), F.sum(x - 3000000).alias("total"), F.sum((x - 3000000) * (x - 3000000)).alias("squares"), F.min(x).alias("low"), F.max(x).alias("high"), bins.alias("bins"))
    rows = sorted(map(tuple, true.collect()))
    assert len(rows) > 1000 and sorted(map(tuple, found.collect())) == rows


def test_sums_make_no_pairs(spark, tmp_path, monkeypatch):
    v = _folder(spark, tmp_path, 30, 400, 20, (1, 5))
    expected = v.predictions.agg(F.var_pop("score"), F.avg("score")).first()

    def made(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(type(v), "candidates", made)
    found = pair_sums.moments(v.score_sums()).first()
    assert (found["var"], found["mean"]) == pytest.approx(tuple(expected))


def test_parts_are_made_once(spark, tmp_path, monkeypatch):
    v = _folder(spark, tmp_path, 20, 100, 20, (1, 5))
    made, real = [], type(v).parts.fget
    monkeypatch.setattr(type(v), "parts", property(lambda self: made.append(1) or real(self)))
    assert v.train.count() + v.test.count() + v.part("val").count() == v.rated.count() == 400
    v._biases()
    assert len(made) == 1
