import random

import pytest
import xxhash
from pyspark.sql import functions as F

from evenkeel.llm import simhash_dedup as S
from evenkeel.llm.common import row_key, text_of
from evenkeel.llm.components import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_brute_force(docs, doc_rows):
    prints = [(r[0], brute_print(r[1])) for r in doc_rows]
    distinct = sorted({p for _, p in prints})
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3]
    root = components(links, distinct)
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(least.get(root[p], d), d)
    want = sorted(((d, p, least.get(root[p])) for d, p in prints), key=str)
    got = S.with_components(docs).collect()
    assert sorted(((r["doc_id"], r["fingerprint_bits"] % (1 << 64), r["component_id"]) for r in got), key=str) == want


def test_shingle_hash_is_that_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("old bridges étés")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("old bridges étés".encode(), 42)


@pytest.mark.parametrize("limit", [2, 100])
def test_pairs_in_hot_buckets(spark, limit):
    """All prints lie near a few centres: refined buckets find the same pairs as brute force."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = set()
    for _ in range(300):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    got = S.similar_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket_limit=limit).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_masks_cover_every_pair_of_close_prints():
    rng = random.Random(1)
    for level in S.block_masks(5, 3, 2):
        masks = [m for _, m in level]
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not diff & m for m in masks)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(300, 299)]
    nodes = {x for e in edges for x in e}
    want = components(edges, nodes)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def roots_of(docs):
    return S._grouped(docs, "doc_id", "text").select("fingerprint_bits", "root").distinct()


def test_keep_one(docs, clashing, empty):
    kept = S.keep_one(clashing)
    assert kept.columns == clashing.columns
    groups = S.with_components(docs)
    assert kept.count() == groups.select("fingerprint_bits").join(roots_of(docs), "fingerprint_bits").select("root").distinct().count()
    assert {r["doc_id"] for r in kept.collect()} >= {3}
    assert not {r["doc_id"] for r in kept.collect()} & {100, 101, 102, 103}
    assert S.keep_one(empty).count() == 0 and S.with_components(empty).count() == 0


def test_keep_one_tells_groups_without_own_ids_apart(spark):
    """Different texts stay though their ids are null, -1 or repeated; copies among them go."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (-1, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[0]), (8, texts[3])]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(zip([None, None, -1, 7, 7], texts), key=str)


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_similar_texts_against_brute_force(spark):
    """Most pairs at 0.8 and more are linked, none far below; repeated and null ids of other texts stay apart."""
    rng = random.Random(5)
    stock = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(stock) for _ in range(rng.randint(80, 300))]
        texts += [" ".join(base), *[edited(rng, base, max(1, len(base) * k // 100)) for k in (1, 1, 1, 2, 6)]]
    texts += ["", None, " \t", "one", "ONE", "one two", texts[0].upper(), texts[0].replace(" ", "\n")]
    rows = [(i % 90 if i % 5 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    digests = docs.select("text", row_key("doc_id", text_of("text")).alias("row_digest"))
    got = {r["text"]: r["root"] for r in S.similar_groups(docs).drop("doc_id").join(digests, "row_digest").collect()}
    linked = found = 0
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            j = jaccard(a or "", b or "")
            linked += j >= 0.8
            found += j >= 0.8 and got[a] == got[b]
    assert linked > 150 and found >= 0.99 * linked
    members = {}
    for t, root in got.items():
        members.setdefault(root, []).append(t or "")
    for group in members.values():
        assert all(any(jaccard(a, b) >= 0.79 for b in group if b is not a) for a in group if len(group) > 1)
    kept = S.keep_similar_one(docs).collect()
    assert len(kept) == len(members) and {got[r["text"]] for r in kept} == set(members)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text, most of them near it and not near each other, are one group; those further off stay."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**4)}" for _ in range(140)]
    texts = [" ".join(base)] + [edited(rng, base, rng.randint(1, 7)) for _ in range(150)]
    got = {r["doc_id"]: r["root"] for r in S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    want, have = {}, {}
    for i in range(len(texts)):
        want.setdefault(top(i), set()).add(i)
        have.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_differences_lose_no_pair_and_make_few(spark):
    """Every similar pair of a group is certain, joined by certain links, or among the further pairs, which are few."""
    rng = random.Random(21)
    base = [f"b{rng.randrange(10**4)}" for _ in range(150)]
    places = rng.sample(range(150), 12)
    texts = [" ".join(base)]
    for i in range(160):
        words = list(base)
        for at in rng.sample(places, rng.randint(1, 6)) if i % 2 else rng.sample(range(150), rng.randint(1, 7)):
            words[at] = f"x{at}" if i % 4 == 1 else f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words[: rng.choice([150, 150, 90])]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {t: S.xxhash.xxh64_intdigest(S._set_of(t.encode().split()).tobytes(), S.SEED) - (1 << 63) for t in texts}
    rows = docs.select("doc_id", row_key("doc_id", text_of("text")).alias("row_digest"), "text").join(spark.createDataFrame(list(keys.items()), "text string, set_key long"), "text").drop("text")
    groups = rows.select(F.lit(1).cast("long").alias("hub"), "set_key").distinct()
    differences = S._differences(docs, rows, groups, "doc_id", "text")
    certain = S._certain_links(differences)
    roots = connected_components(certain)
    pairs = {(r["key_a"], r["key_b"]) for r in S._further_pairs(differences, roots).collect()}
    root = {r["node"]: r["root"] for r in roots.collect()}
    text = {k: t for t, k in keys.items()}
    assert all(jaccard(text[r["a"]], text[r["b"]]) >= 0.8 for r in certain.collect())
    distinct, similar = sorted(text), 0
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if jaccard(text[a], text[b]) >= 0.8:
                similar += 1
                assert root.get(a, a) == root.get(b, b) or (a, b) in pairs
    assert similar > 200 and len(pairs) < len(distinct) * (len(distinct) - 1) / 8


def test_similar_edges(docs, clashing, empty):
    kept = S.keep_similar_one(clashing)
    assert kept.columns == clashing.columns and not {r["doc_id"] for r in kept.collect()} & {100, 101, 102, 103, 111, 112, 113, 201, 202}
    assert S.keep_similar_one(empty).count() == 0
