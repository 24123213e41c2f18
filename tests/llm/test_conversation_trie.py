import hashlib
import random
import zlib

import pytest

from evenkeel.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len((text or "").encode().split())


def brute(rows):
    """Tries by hand: every rebuilt conversation's prefixes as tuples."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)]
        saved = sum((len(members[m]) - 1) * words(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(node))
        children = sum(len(x) == len(node) + 1 and x[:-1] == node for x in members)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(rng):
    rows = []
    for c in [*range(0, 50), 1000, 1003, -7, -20, -25, 2**61]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b c", "hello there", "x", ""])) for t in range(rng.randint(0, 9)) if c != 40]
    rows += [(60, t, "user", f"turn {t}") for t in range(70)]  # deep
    rows += [(61, None, "user", "first"), (61, None, None, None), (61, 3, "user", "third"), (61, 3, "user", "third"), (61, 3, "assistant", "tie")]
    rows += [(None, 0, "user", "no conversation"), (41, 1, "user", "only one"), (45, 1, "user", "only one")]
    return rows


def result(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = rows_of(random.Random(seed))
    assert result(T.shared_prefixes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_runs_hot_nodes_and_joined_ends_do_not_show(spark, monkeypatch):
    rng = random.Random(9)
    rows = rows_of(rng) + [(c, t, "user", "copy") for c in range(200, 300) for t in range(5)]
    monkeypatch.setattr(T, "RUN", 7)
    monkeypatch.setattr(T, "HOT_SHARE", 3)
    monkeypatch.setattr(T, "ENDS", 2)
    assert result(T.shared_prefixes(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


def test_clashing_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(rows_of(random.Random(4)), SCHEMA)
    clash = rows.select("*", *[F.lit("x").alias(c) for c in ("pos", "key", "parent", "digest", "words", "n", "base", "_part", "length")])
    assert result(T.shared_prefixes(rows)) == result(T.shared_prefixes(clash))
    assert T.shared_prefixes(rows.where("false")).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    # 41 has one turn, less than its h, and no conversation 40 is there.
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 1)
    got = T.shared_prefixes(spark.createDataFrame([(c, 0, "user", "gone")], SCHEMA)).collect()
    assert len(got) == 1 and got[0]["depth"] == 0 and got[0]["n_leaves"] == 1 and got[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_very_long_conversation_and_text(spark):
    rows = [(20, t, "user", "w " * 5000 if t == 3 else f"t{t}") for t in range(300)] + [(21, t, "user", f"t{t}") for t in range(3)]
    assert result(T.shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
