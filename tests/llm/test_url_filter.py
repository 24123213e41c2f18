import os

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import url_filter as U
from evenkeel.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://A.Example.COM", "http://a.example.com/de/x?y=1#z", "https://example.net/en/1", "https://m.example.net/EN/1", "https://x.net", "https://x.net/", "https://notexample.com/de/", "http://example.com?/de/", "ftp://b.org/fr/#a", "x://y.org/fr", "http://É.net/en/", "http://h.net:80/a b", "a://b://c/d", "http://www.spam-farm.example.org/" + "9" * 5000]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return host, rest[:end]


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(str(r)), default=None)


def pages(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 3)] + [(None, "http://q.net/", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, host string")


def test_parts_and_rules_against_brute_force(spark):
    for r in U.judge_urls(pages(spark), URL_RULES).collect():
        host, path = split(r["url"])
        rule = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, str(rule) if rule else None)
        assert r["verdict"] == rule.action if rule else r["verdict"] in ("allow", "block")


def test_rule_tables_give_the_same(spark):
    table = spark.createDataFrame([(r.host, r.path, r.action) for r in URL_RULES], "host string, path string, action string")
    parted = U.add_parts(pages(spark).drop("host"))
    for r in U.join_rules(parted, table).collect():
        rule = rule_of(r["host"], r["path"])
        assert (r["rule"], r["rule_action"]) == ((str(rule), rule.action) if rule else (None, None))


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("abcd",), ("zzz",)], "u string").select(U.entropy(F.col("u")).alias("e")).collect()
    assert [round(r["e"], 6) for r in got] == [1.0, 0.0, 2.0, 0.0]


def labelled(spark, rows):
    return U.add_parts(spark.createDataFrame(rows, "url string, blocked boolean, rule string"))


def test_trees_learn_lexical_features_for_hidden_hosts_and_rules(spark):
    """Long runs of digits are what is blocked; hosts and the rule of one suffix are kept from learning."""
    def url(i, suffix):
        return f"http://host{i % 60}.{suffix}/{'7' * 12 if i % 2 else 'pages/about/us'}/{i % 7}"

    rows = [(url(i, s), i % 2 == 1, f"{s}-{i % 2}") for s in ("zone", "one", "two") for i in range(300) if i % 60 < 45]
    model = U.train(labelled(spark, rows))
    assert sum(model.trees.featureImportances[i] for i in range(len(U.LEXICAL))) > 0.9
    hidden = [(url(i, s), i % 2 == 1, None) for s in ("zone", "hid") for i in range(300) if i % 60 >= 45]
    got = model.verdict(labelled(spark, hidden)).collect()
    assert sum((r["model_verdict"] == "block") == r["blocked"] for r in got) >= 0.95 * len(got)


def test_a_suffix_labelled_by_one_rule_has_no_rate(spark):
    rows = [(f"http://h{i}.com/de/{i}", True, "com/de/") for i in range(80)] + [(f"http://h{i}.org/fr/{i}", False, "org/fr/") for i in range(80)]
    rows += [(f"http://h{i}.net/x/{i}", i % 4 > 0, f"net-{i % 4}") for i in range(80)]
    model = U.train(labelled(spark, rows))
    rates = {r["suffix"]: r["rate"] for r in model.rates.collect()}
    assert rates["com"] == rates["org"] == model.prior and rates["net"] > model.prior


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_no_suffix_is_judged_all_one_way(spark):
    out = U.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url"), URL_RULES)
    counts = out.where("rule IS NULL").groupBy(U.suffix_of(F.col("host")).alias("suffix")).agg(F.avg((F.col("verdict") == "block").cast("int")).alias("share"), F.count("*").alias("n"))
    found = {r["suffix"]: r["share"] for r in counts.collect() if r["n"] > 100}
    assert set(found) == {"com", "org"} and all(0 < x < 1 for x in found.values())


def test_columns_of_the_features_names_stay(spark):
    names = [*U.FEATURES, "suffix", "features", "prediction", "probability", "rawPrediction", "label", "fold", "rate", "_url", "_action", "model_verdict"]
    plain = pages(spark)
    clashing = plain.select("*", *[F.lit("mine").alias(n) for n in names])
    got = U.judge_urls(clashing, URL_RULES)
    assert got.where(" AND ".join(f"`{n}` = 'mine'" for n in names)).count() == plain.count()
    key = ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, U.judge_urls(plain, URL_RULES).select(*key).collect()))


def test_empty_and_one_sided(spark):
    assert U.judge_urls(pages(spark).limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in U.judge_urls(pages(spark), []).collect()} == {"allow"}
