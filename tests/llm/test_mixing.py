import hashlib

from evenkeel.llm import mixing as M


def targets(sizes, cycle=(1, 2, 3)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(cycle[i % len(cycle)]) for i, s in enumerate(names)}
    total, held = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in held]
        w = sum(weight[s] for s in free)
        if not free:
            return held
        share = {s: (total - sum(held.values())) * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return held | share
        held |= {s: 3.0 * sizes[s] for s in over}


def test_brute_force(docs, doc_rows):
    rows = [(r[0] if r[0] is not None else f"null:{hashlib.md5((r[1] or '').encode()).hexdigest()}", r[3], len((r[1] or "").encode().split())) for r in doc_rows]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want_targets = targets(sizes)
    want = []
    for s in sizes:
        own = sorted(((hashlib.md5(f"{i}:mix-0".encode()).hexdigest(), n, i) for i, src, n in rows if src == s), key=lambda x: x[:2])
        epochs, before = int(want_targets[s] // sizes[s]) if sizes[s] else 0, 0
        rest = want_targets[s] - epochs * sizes[s]
        for _, n, i in own:
            want.append(("None" if str(i).startswith("null:") else str(i), n, (epochs + (rest > 0 and 2 * (rest - before) >= n)) * n))
            before += n
    got = M.mix_sources(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == sorted(want)
    for r in got:
        assert abs(r["target"] - want_targets[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]


def test_ranges_follow_the_largest_source(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('a b ', id) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 40)) AS source")
    assert M.range_bits(docs, "source") == 8 and M.range_bits(docs, "source", rows=2) == 10
    a, b = (sorted(map(str, M.mix_sources(docs, bits=n).collect())) for n in (0, 12))
    assert a == b


def test_rows_without_ids_are_spread(spark):
    docs = spark.range(500).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('a b c ', id) AS text", "'s' AS source").union(spark.sql("SELECT 1L, 'x', 't'"))
    plan = M.mix_sources(docs)
    assert plan.select("mix_key").distinct().count() == 501
    got = M.mixed_documents(docs).groupBy("text").count().collect()
    assert len(got) == plan.where("copies > 0").count() and sum(r["count"] for r in got) == plan.agg({"copies": "sum"}).first()[0]


def test_taken_words_come_near_the_targets(docs):
    rows = M.mix_sources(docs).groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2 + 1e-6 for r in rows)


def test_mixed_documents(docs, clashing, empty):
    copies = {}
    for r in M.mix_sources(docs).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    out = M.mixed_documents(clashing)
    assert out.columns == clashing.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}
    assert M.mixed_documents(empty).count() == 0 and M.mix_sources(empty).count() == 0


def test_reruns_agree(docs):
    a, b = (sorted(map(str, M.mix_sources(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b
