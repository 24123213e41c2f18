import hashlib

from evenkeel.llm import line_dedup

SPACE = " \t\n\x0b\f\r"
LAST = 1 << 62


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    owner = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                d = LAST if doc_id is None else doc_id
                owner[key(line)] = min(owner.get(key(line), d), d)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        d = LAST if doc_id is None else doc_id
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == d]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def test_brute_force(docs, doc_rows):
    want = brute([(r[0], r[1]) for r in doc_rows])
    assert got(line_dedup.dedup_lines(docs)) == want
    assert got(line_dedup.dedup_lines(docs, batch_lines=10**6, buckets=3)) == want
    assert got(line_dedup.dedup_lines(docs, batch_lines=25, fanout=2)) == want


def test_clashing_columns_and_empty(docs, clashing, empty):
    assert got(line_dedup.dedup_lines(clashing)) == got(line_dedup.dedup_lines(docs))
    assert "owner" in line_dedup.dedup_lines(clashing).columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_runs_are_levelled_and_kept_between_calls(spark, docs):
    runs = line_dedup.LineRuns(spark, fanout=2)
    first = docs.where("doc_id < 30")
    line_dedup.dedup_lines(first, batch_lines=15, runs=runs)
    assert all(len(level) < 2 for level in runs.levels) and len(runs.levels) > 2
    assert runs.owners().count() == runs.owners().select("h1", "h2").distinct().count()
    again = line_dedup.dedup_lines(first.selectExpr("doc_id + 1000 AS doc_id", "text"), runs=runs)
    left = [x for r in again.collect() for x in r["kept_text"].split("\n")]
    assert all(len(key(x)) < 10 for x in left)
    runs.close()


def test_compaction_and_anti_join_do_not_shuffle_the_runs(spark, docs):
    runs = line_dedup.LineRuns(spark, fanout=9)
    hashes = line_dedup.line_hashes(docs)
    for low in (0, 20, 40):
        line_dedup.add_batch(runs, hashes.where(f"owner >= {low} AND owner < {low + 20}"))
    assert [len(x) for x in runs.levels] == [3]
    plan = runs.merged(runs.levels[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = runs.unseen(line_dedup._least_owners(hashes))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("LeftAnti") == 3 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 3
    merged = runs.merged(runs.levels[0]).count()
    runs.add(hashes.limit(0).select("h1", "h2", "owner"))
    assert runs.owners().count() == merged
    runs.close()


def test_nothing_is_left_behind(spark, docs):
    from evenkeel.llm import common

    before = len(spark.catalog.listTables())
    line_dedup.dedup_lines(docs, batch_lines=50).count()
    assert len(spark.catalog.listTables()) == before
    common.release(spark)
