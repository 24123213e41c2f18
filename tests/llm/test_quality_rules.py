import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_statistics_against_brute_force(spark, docs, doc_rows):
    extra = [(900, "a b c a b c x y z # * | <>\nline one\nline one\n \n \nline one", "", "", 0), (901, "a a a a a a", "", "", 0)]
    rows = docs.union(spark.createDataFrame(extra, docs.schema))
    got = Q.add_statistics(rows).select("doc_id", *Q.BASE, "base_failed").collect()
    want = [(r[0], *brute(r[1])) for r in [*doc_rows, *extra]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decision_list_finds_planted_rules():
    rng = random.Random(5)
    rows = []
    for i in range(900):
        row = {f: rng.random() for f in Q.FEATURES} | {"prune": i % 3 == 0}
        bad = row["symbol_share"] > 0.8 or (row["upper_share"] > 0.7 and row["mark_share"] > 0.6)
        rows.append(row | {"bad": int(bad)})
    rules = Q.learn_decision_list(rows)
    wrong = sum(any(rule.holds(r) for rule in rules) != bool(r["bad"]) for r in rows)
    assert rules and wrong < 30
    assert Q.learn_decision_list([r | {"bad": 0} for r in rows]) == []
    assert Q.learn_decision_list([]) == []


def test_verdict_equals_the_rules(spark):
    rules = [Q.Rule([("mean_word", True, 3.0), ("repeat_share", False, 0.5)]), Q.Rule([("upper_share", True, 0.5)])]
    rng = random.Random(2)
    rows = [{f: rng.random() * 6 for f in Q.FEATURES} for _ in range(50)]
    got = spark.createDataFrame(rows).withColumn("kept", Q.verdict(rules)).collect()
    assert all(r["kept"] == (not any(rule.holds(r.asDict()) for rule in rules)) for r in got)


def test_judged_documents(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = Q.judge_documents(clashing, labels)
    assert out.count() == docs.count() and "copies" in out.columns
    assert all(not r["kept"] for r in out.where("base_failed").collect())
    none = labels.limit(0)
    assert {r["kept"] for r in Q.judge_documents(docs, none).where("NOT base_failed").collect()} == {True}
    assert Q.judge_documents(empty, labels).count() == 0
    assert "Filter" not in Q.add_statistics(docs).where("n_words > 3")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1]


def test_filter_on_statistics_is_not_pushed_into_them(docs):
    assert Q.add_statistics(docs).where("NOT base_failed AND repeat_share < 0.4").count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_documents(spark):
    """A list learned from three quarters of the labels judges the others as they are labelled."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    kept_back = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    model = Q.learn_decision_list(Q.labelled_statistics(docs, labels.where(~kept_back)))
    judged = Q.add_statistics(docs.join(labels.where(kept_back), "doc_id").select("text", "quality")).where("NOT base_failed").select("quality", Q.verdict(model).alias("kept")).collect()
    bad, good = [r["kept"] for r in judged if r["quality"] == 0], [r["kept"] for r in judged if r["quality"] == 1]
    assert len(bad) > 40 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.98 * len(good)
