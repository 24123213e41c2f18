"""Trie of conversation prefixes, rolled up by pointer jumping over digest-keyed parent edges.

Every prefix of a conversation has a digest that is a sum over its turns, so prefixes come from running
sums. Conversations that share a prefix meet in one node. Leaf counts and savings then reach all
ancestors in rounds: after round k a node holds the sums of all nodes less than 2^k below it and
points 2^k up, so the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, drop_table, materialize, positions_within, ship

#: Turns whose running sums are made together; longer conversations are made of several such runs.
RUN = 4096
#: Parts of 32 bits in the sum that is a prefix's digest: sums of as many as 2^31 turns stay exact.
LIMBS = 4
#: A node with more than one in so many of all nodes below it is joined by broadcast; there are fewer than so many.
HOT_SHARE = 1000
#: Conversation ids joined in one text before they are hashed.
ENDS = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Numbers the turns of every conversation from 1: (conv_id, pos, digest, words).

    Turns are ordered by ``turn``, null first; ties by the digest of role and text, so rows that tie
    and differ have one order, and repeated rows stay as turns of their own. Null roles and texts are
    empty. Rows without a conversation id belong to none and are left out. Texts are read whole, but
    only their digests and word counts move; a conversation of any length is spread over many tasks.
    """
    role_of, text_of = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role_of).cast("string"), F.lit(":"), role_of, text_of), 256))
    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(text_of, F.lit(WORD)).cast("long").alias("words"))
    return positions_within(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "pos", "ordered-turns").drop("turn")


def rebuilt_turns(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Gives each conversation c the first h turns of conversation c - c % ``block`` and then its own after its first h.

    h is the unsigned CRC-32 of the decimal c modulo ``heads``. Returns the turns as in
    ``ordered_turns`` with ``length``, the rebuilt conversation's turns, and (conv_id, length) of all
    conversations, also of those without turns.
    """
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    kept = counted.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    shared = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = kept.join(shared, "base", "left").withColumn("head", head)
    convs = materialize(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "conversations")
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    ahead = convs.where("head > 0").join(first, "base").where("pos <= head")
    own = turns.join(convs, "conv_id").where("pos > h").withColumn("pos", F.col("head") + F.col("pos") - F.col("h"))
    columns = ("conv_id", "pos", "digest", "words", "length")
    return ahead.select(*columns).union(own.select(*columns)), convs.select("conv_id", "length")


def _sums(turns: DataFrame) -> DataFrame:
    """Adds each turn's parts of the digest and their running sums over its conversation."""
    own, sums = [f"d{i}" for i in range(LIMBS)], [f"s{i}" for i in range(LIMBS)]
    hashes = [F.xxhash64(F.lit(i), "digest", "pos") for i in range(LIMBS // 2)]
    parts = [p for x in hashes for p in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    cut = turns.select("*", *[p.alias(name) for p, name in zip(parts, own)], F.floor((F.col("pos") - 1) / RUN).cast("long").alias("run"))
    running = Window.partitionBy("conv_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select("*", *[F.sum(a).over(running).alias(b) for a, b in zip(own, sums)])
    # Only conversations longer than one run have sums to carry over.
    long = cut.where(F.col("length") > RUN).groupBy("conv_id", "run").agg(*[F.sum(a).alias(a) for a in own])
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = long.select("conv_id", "run", *[F.sum(a).over(before).alias(f"c{i}") for i, a in enumerate(own)])
    short = summed.where(F.col("length") <= RUN)
    further = summed.where(F.col("length") > RUN).join(carried, ["conv_id", "run"])
    further = further.withColumns({s: F.col(s) + F.coalesce(f"c{i}", F.lit(0)) for i, s in enumerate(sums)}).drop(*[f"c{i}" for i in range(LIMBS)])
    return short.unionByName(further)


def _key(depth: Column, parts: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", *[x.cast("string") for x in (depth, *parts)]))


def _root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * LIMBS)


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending decimal ``conv_id`` of each ``key``, comma-joined: (key, ends_sha256).

    Ids are sorted and joined to texts of bounded length in many tasks, whatever a key's share of
    them is; only the hash itself, which is one chain by definition, reads a key's texts in a row.
    """
    ship(ends.sparkSession)
    most = ENDS
    ordered = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, first = None, [], None
        rows: list[tuple] = []
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or len(held) == most:
                    if held:
                        rows.append((key, first, ",".join(held)))
                    key, held, first = k, [], c
                held.append(str(c))
            yield _texts(rows)
            rows = []
        if held:
            yield _texts([(key, first, ",".join(held))])

    def _texts(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["key", "first", "ids"])

    texts = ordered.select("key", "conv_id").mapInArrow(joined, "key string, first long, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if chain is not None:
                        done.append((key, chain.hexdigest()))
                    key, chain = k, hashlib.sha256(ids.encode())
                else:
                    chain.update(f",{ids}".encode())
            yield _hashes(done)
        if chain is not None:
            yield _hashes([(key, chain.hexdigest())])

    def _hashes(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "ends_sha256"])

    return texts.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(hashed, "key string, ends_sha256 string")


def roll_up(nodes: DataFrame, values: list[str], depth: int) -> DataFrame:
    """Sums ``values`` of every node (key, parent, ...) over its subtree, the node included.

    ``depth`` is the largest depth. Each round is one aggregation and one join of all nodes with the
    nodes they point to. A node to which more than one in ``HOT_SHARE`` of all nodes point is joined by
    broadcast; there are fewer than ``HOT_SHARE`` of these, so no task gets more than its share.
    Every round is written; the one before it is removed.
    """
    state, span, total = nodes.select("key", "parent", *values), 1, nodes.count()
    while span <= depth:
        below = state.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
        below = materialize(below, "trie-below")
        next_up = state.select(F.col("key").alias("parent"), F.col("parent").alias("_next"))
        hot = next_up.join(below.where(F.col("_n") > total // HOT_SHARE).select("parent"), "parent", "left_semi").withColumn("_hot", F.lit(True))
        met = state.join(F.broadcast(hot), "parent", "left")
        cold = met.where("_hot IS NULL AND parent IS NOT NULL").drop("_next", "_hot").join(next_up, "parent")
        jumped = met.where("_hot OR parent IS NULL").select("key", "_next", *values).union(cold.select("key", "_next", *values))
        added = jumped.join(below.drop("_n").withColumnRenamed("parent", "key"), "key", "left")
        after = materialize(added.select("key", F.col("_next").alias("parent"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "trie-round")
        if span > 1:
            drop_table(state)
        drop_table(below)
        state, span = after, 2 * span
    return state.select("key", *values)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of all prefixes of the conversations.

    ``turns`` are (conv_id, pos, digest, words, length), ``convs`` (conv_id, length) of all
    conversations, as from ``rebuilt_turns``. Returns a row for each node: ``conv_id`` (its smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256`` and its ``key``. The root is there if any conversation is; empty tables give no rows.
    """
    summed = _sums(turns)
    key = _key(F.col("pos"), [F.col(f"s{i}") for i in range(LIMBS)])
    up = _key(F.col("pos") - 1, [F.col(f"s{i}") - F.col(f"d{i}") for i in range(LIMBS)])
    steps = materialize(summed.select("conv_id", "pos", "length", "words", key.alias("key"), up.alias("parent")), "trie-steps")
    grown = steps.groupBy("key", "parent").agg(F.min("conv_id").alias("conv_id"), F.min("pos").cast("long").alias("depth"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(_root_key().alias("key"), F.lit(None).cast("string").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = grown.select("key", "parent", "conv_id", "depth", "n_convs", "words").union(root)
    children = grown.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.select("key", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "trie-nodes")
    size = nodes.agg(F.max("depth"), F.count("*")).first()
    rolled = roll_up(nodes, ["n_leaves", "saved_tokens"], size[0] or 0)
    ends = steps.where("pos = length").select("key", "conv_id").union(convs.where("length = 0").select(_root_key().alias("key"), "conv_id"))
    # The parent's smallest member: that of a node that many share comes by broadcast, as in a round.
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = above.where(F.col("n_children") > size[1] // HOT_SHARE).select("parent", F.col("parent_conv_id").alias("_hot"))
    met = nodes.join(F.broadcast(hot), "parent", "left")
    known = met.where("_hot IS NOT NULL OR parent IS NULL").withColumnRenamed("_hot", "parent_conv_id")
    found = met.where("_hot IS NULL AND parent IS NOT NULL").drop("_hot").join(above.drop("n_children"), "parent")
    columns = ("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
    out = known.select(*columns).union(found.select(*columns)).join(rolled, "key").join(ends_digest(ends), "key", "left")
    return out.select(*columns[1:], "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "key")


def shared_prefixes(conversations: DataFrame, **columns: str) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(*rebuilt_turns(ordered_turns(conversations, **columns)))
