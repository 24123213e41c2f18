"""Constants that are known for these statistics, and properties of the measures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import prepare
from evenkeel.plans import fairness, ranking, statistics

# Two samples and the statistics known for them.
X = (3.22461582936, 2.99218086243, 3.9966970832, 4.37996292304, 4.31471229859, 3.50467566847, 4.21731218391, 4.51771680394, 3.8497338358, 4.51715982848)
S = (1, 1, 1, 1, 1, 1, 0, 1, 0, 1)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(x, bool(s)) for x, s in zip(X, S)], "x double, s boolean")


def frame(spark, x, s):
    return spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, s)], "x double, s boolean")


def test_ks(sample):
    r = statistics.ks_statistic(sample, "x", "s").first()
    assert r["ks"] == pytest.approx(0.5)
    assert statistics.ks_p_value(r["ks"], r["n1"], r["n2"]) == pytest.approx(0.65087283170400867, rel=1e-6)


def test_cdf_area(spark, sample):
    r = statistics.cdf_area(sample, "x", "s").first()
    assert (r["area"], r["width"], r["difference"]) == pytest.approx((0.35437443911875, 1.52553594151, 0.232295044302912), rel=1e-6)
    assert statistics.cdf_area(frame(spark, [1, 1, 1, 5], [0, 0, 1, 1]), "x", "s").first()["difference"] == pytest.approx(0.5)
    assert statistics.cdf_area(frame(spark, [0.1, 0.4, 0.9, 0.2, 0.3, 0.5, 0.8], [0, 0, 0, 1, 1, 1, 1]), "x", "s").first()["difference"] == pytest.approx(1 / 6)
    assert statistics.cdf_area(frame(spark, [0.5, 0.5], [0, 1]), "x", "s").first()["difference"] == 0
    with pytest.raises(Exception, match="a group is empty"):
        statistics.cdf_area(frame(spark, [0.5, 0.5], [1, 1]), "x", "s").collect()


def binned(sample, step=4.0):
    return sample.withColumn("b", prepare.score_bin(F.col("x"), 1.0, 5.0, step))


def test_chi_square(sample):
    r = statistics.chi_square(binned(sample), "b", "s").first()
    assert r["dof"] == 1 and r["chi2"] == pytest.approx(0.625)
    assert statistics.chi_square_tail(r["chi2"], 1) == pytest.approx(0.42919530044034926, rel=1e-9)


def test_mutual_information(sample):
    r = statistics.mutual_information(binned(sample, 1.0), "b", "s").first()
    assert r["mi"] == pytest.approx(0.1184939225613002) and r["gmean"] == pytest.approx(0.17183544089285782)


def test_chi_square_tails():
    assert statistics.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert statistics.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert statistics.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)


def by_hand(rel):
    """The measures of one list, position by position."""
    hits = [i for i, r in enumerate(rel) if r]
    gain = lambda x: sum(r / math.log2(max(i, 1) + 1) if i else r for i, r in enumerate(x))
    best = gain(sorted(rel, reverse=True))
    return {
        "mrr": 1 / (hits[0] + 1) if hits else 0.0,
        "average_precision": sum((n + 1) / (i + 1) for n, i in enumerate(hits)) / len(hits) if hits else 0.0,
        "dcg0": gain(rel),
        "ndcg0": gain(rel) / best if best else 0.0,
    }


def test_list_metrics_against_counting_by_hand(spark):
    rng = random.Random(17)
    lists = {f"l{n}": [rng.choice([0, 0, 1, 2, 5] if n % 2 else [0, 1]) for _ in range(rng.randint(1, 12))] for n in range(20)} | {"none": [0, 0, 0]}
    rows = [(k, i, r) for k, rel in lists.items() for i, r in enumerate(rel)]
    got = {r["k"]: r for r in ranking.list_metrics(spark.createDataFrame(rows, "k string, i int, rel int"), "k", "i", "rel").collect()}
    for k, rel in lists.items():
        for name, want in by_hand(rel).items():
            assert (got[k][name] or 0.0) == pytest.approx(want), (k, name)


def scored(spark):
    rows = [(1, 1, 4.0, True, 5.0), (2, 1, 3.0, False, 3.0), (3, 1, 2.0, True, 1.0), (1, 2, 1.0, True, 2.0), (2, 2, 5.0, False, 4.0), (4, 3, 2.5, False, 2.0)]
    return spark.createDataFrame(rows, "user_id int, item_id int, score double, sensitive boolean, rating double")


def test_swapping_groups_changes_no_absolute_measure(spark):
    a = scored(spark)
    b = a.withColumn("sensitive", ~F.col("sensitive"))
    for measure in (fairness.mean_difference, fairness.rating_equal_opportunity, fairness.unfairness, fairness.epsilon_fairness):
        assert tuple(measure(a).first()) == pytest.approx(tuple(measure(b).first()))
    assert fairness.rating_demographic_parity(a).first()["value"] is None


def test_entropy_index_adds_up(spark):
    rows = [(i, i % 2 == 0, 1.0 + i * 0.3) for i in range(12)]
    b = spark.createDataFrame(rows, "user_id int, sensitive boolean, benefit double")
    values = [r[2] for r in rows]
    mean = sum(values) / len(values)
    for alpha, want in ((2, sum((v / mean) ** 2 - 1 for v in values) / 24), (1, sum(v / mean * math.log(v / mean) for v in values) / 12)):
        assert fairness.entropy_index(b, alpha).first()["total"] == pytest.approx(want)


def test_fair_reranking_meets_the_constraint(spark):
    rows = [(u, 10 * u + i, 1.0 - i / 10, u % 2 == 0, int(i < 2 if u % 2 == 0 else i in (3, 4))) for u in range(20) for i in range(6)]
    c = spark.createDataFrame(rows, "user_id int, item_id int, score double, sensitive boolean, label int")
    out = fairness.fair_rerank(c, 3, 1.0)
    per = out.groupBy("user_id", "sensitive").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    assert {r["n"] for r in per.collect()} == {3}
    means = {r["sensitive"]: r["m"] for r in per.groupBy("sensitive").agg(F.avg("hits").alias("m")).collect()}
    assert abs(means[True] - means[False]) <= 1.0 + 1e-9


def test_epsilon_fairness_goes_past_items_of_one_group(spark):
    """The first 60 items have one group's scores only: the pairs of the last three count, or the first two of them."""
    rows = [(1, i, float(i), True) for i in range(63)] + [(2, 60, 3.0, False), (2, 61, 2.0, False), (2, 62, 1.0, False), (3, 60, 1.0, False), (3, 61, 2.0, False), (3, 62, 0.0, False)]
    scored = spark.createDataFrame(rows, "user_id long, item_id long, score double, sensitive boolean")
    # P(first above second): 0 in group 1; 1/2, 1 and 1 in group 2.
    assert fairness.epsilon_fairness(scored).first()["value"] == pytest.approx(2.5 / 3)
    assert fairness.epsilon_fairness(scored, max_pairs=2).first()["value"] == pytest.approx(0.75)
