import random
import re

import pytest

from evenkeel.llm import source_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top=50):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = {}
        for _, _, terms in own:
            for t in set(terms):
                held[t] = held.get(t, 0) + 1
        kept = [t for t, n in held.items() if n >= min_docs]
        count = {s: {t: 0 for t in kept} for s in {d[1] for d in own}}
        for _, s, terms in own:
            for t in terms:
                if t in count[s]:
                    count[s][t] += 1

        def p(n):
            return {t: 1 + 1000000000 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        q, shares = p({t: sum(n[t] for n in count.values()) for t in kept}), {s: p(n) for s, n in count.items()}
        for s in shares:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in shares if o != s]
            terms = [(q[t] - shares[s][t], t.encode(), t) for t in kept if count[s][t] > 0 and shares[s][t] > q[t]]
            out += [(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -v, k) for k, (v, _, x) in enumerate(sorted(terms)[:top], 1)]
    return sorted(map(str, out))


def result(df):
    return sorted(str((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"])) for r in df.collect())


def rows_of(rng, n=400, sources=13):
    stock = [f"{a}{b}" for a in ("Wort", "ÜBER", "x", "日本", "mot") for b in "abcdefghijklmnop"]
    rows = []
    for i in range(n):
        source = f"s{min(int(rng.expovariate(0.3)), sources - 1)}"
        bias = sum(map(ord, source)) % len(stock)
        text = " ".join(rng.choice(stock[bias : bias + 9] if rng.random() < 0.4 else stock) + rng.choice(["", ".", "1", "_"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source if rng.random() < 0.95 else None))
    return rows + [(900, None, "fr", "a"), (901, "", "fr", "b"), (902, "\x7f@[`{ 12", "xx", ""), (903, "ΣΑΣ É́ " * 3000, "en", "long"), rows[5], rows[5], (904, "none kept here", "en", "lonely")]


@pytest.mark.parametrize("min_docs", [2, 20, 10**6])
def test_brute_force(spark, min_docs):
    rows = rows_of(random.Random(min_docs))
    assert result(D.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs)) == brute(rows, min_docs)


@pytest.mark.parametrize("limit", [0, 3, 10**9])
def test_heavy_and_light_give_the_same(spark, monkeypatch, limit):
    from pyspark.sql import functions as F

    rows = rows_of(random.Random(5), 200)
    monkeypatch.setattr(D, "light_limit", lambda n: F.lit(limit).cast("long") + 0 * n)
    monkeypatch.setattr(D, "TILE_TERMS", 7)
    monkeypatch.setattr(D, "TILE_GROUPS", 4)
    monkeypatch.setattr(D, "COUNTED", 50)
    assert result(D.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, 3)) == brute(rows, 5, 3)


def test_clashing_columns_and_empty_tables(docs, clashing, empty):
    assert result(D.source_divergence(docs, 3)) == result(D.source_divergence(clashing, 3)) != []
    assert D.source_divergence(empty).count() == 0
    assert result(D.source_divergence(docs.drop("doc_id"), 3)) == result(D.source_divergence(docs, 3))


def test_shares_of_counts_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n = 9 * 10**17
    got = spark.range(1).select(D.share(F.lit(n), F.lit(n + 3), F.lit(1)).alias("p")).first()["p"]
    assert got == 1 + 1000000000 * (n + 5) // (n + 3 + 5)
