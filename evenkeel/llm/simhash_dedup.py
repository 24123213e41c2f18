"""Near-duplicate detection with SimHash fingerprints and pigeonhole blocks.

A fingerprint of 64 bits is cut into ``n_blocks`` blocks. Fingerprints that differ in at most ``d``
bits agree in at least ``n_blocks - d`` blocks, so every pair to find shares one of the
C(n_blocks, n_blocks - d) keys made of that many blocks. Rows are joined on those keys and the
Hamming distance of each candidate is verified.

Buckets over ``bucket_limit`` distinct fingerprints are not joined: within such a bucket the same
argument holds for the bits that are still free, so its rows are keyed again by blocks of these, to
``depth`` levels. With 5 blocks and 3 bits, three levels fix 50 bits; fingerprints are distinct, so
a bucket of the last level holds 2**14 at most however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, id_order, materialize, own_columns, row_key, ship, text_of
from .components import connected_components

SEED = 42
#: Words of a shingle, similarity and 64-bit words of the long fingerprint of ``keep_similar_one``.
SHINGLE, SIMILARITY, LONGS = 5, 0.8, 8
#: Blocks of a set of shingles and the shingles that make one.
BLOCKS, BLOCK_PIECES = 32, 5
#: (1 + s) / (1 - s) for the similarity s, a whole number at 0.8; the share of a group's sets, one in so many, from which its shingles are ranked.
WEIGHT, KNOWN = round((1 + SIMILARITY) / (1 - SIMILARITY)), 16
_SALTS = np.arange(1, BLOCKS * BLOCK_PIECES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    pieces = _shingles(words, shingle)
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64, len(pieces))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # a very long text needs no more memory than this
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def block_masks(n_blocks: int, distance: int, depth: int) -> list[list[tuple[int, int]]]:
    """For each level the pairs (mask of the level above, mask); a mask's bits are those to agree on."""

    def refine(mask: int) -> list[int]:
        free = [b for b in range(64) if not mask >> b & 1]
        cut = [round(i * len(free) / n_blocks) for i in range(n_blocks + 1)]
        blocks = [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cut, cut[1:])]
        return [mask | sum(chosen) for chosen in combinations(blocks, n_blocks - distance)]

    levels, above = [], [0]
    for _ in range(depth):
        pairs = [(up, down) for up in above for down in refine(up)]
        levels.append(pairs)
        above = sorted({down for _, down in pairs})
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar_pairs(prints: DataFrame, distance: int = 3, n_blocks: int = 5, bucket_limit: int = 100, depth: int = 3) -> DataFrame:
    """All pairs of the distinct fingerprints ``prints`` (fp long) that differ in 1 to ``distance`` bits.

    Returns ``a long, b long`` with a < b, each pair once.
    """
    spark = prints.sparkSession
    rows, found = prints.select("fp", F.lit(0).cast("long").alias("mask")), None
    levels = block_masks(n_blocks, distance, depth)
    for level, pairs in enumerate(levels):
        # A constant table: 10, 100 and 1,000 rows for 5 blocks and 3 bits.
        masks = spark.createDataFrame([(_signed(a), _signed(b)) for a, b in pairs], "mask long, finer long").coalesce(1)
        keyed = rows.join(F.broadcast(masks), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialize(keyed.join(sizes, ["mask", "key"]), "simhash-buckets")
        last = level == len(levels) - 1
        small = shared if last else shared.where(F.col("n") <= bucket_limit)
        a, b = small.select("mask", "key", F.col("fp").alias("a")), small.select("mask", "key", F.col("fp").alias("b"))
        pairs_here = a.join(b, ["mask", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
        found = pairs_here if found is None else found.union(pairs_here)
        if last or shared.where(F.col("n") > bucket_limit).isEmpty():
            break
        rows = shared.where(F.col("n") > bucket_limit).select("fp", "mask")
    return found.distinct()


def with_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = 3, n_blocks: int = 5, bucket_limit: int = 100) -> DataFrame:
    """Groups documents whose fingerprints are linked, directly or through others.

    Returns for each row ``id_column``, ``row_digest long`` (a hash of id and text),
    ``fingerprint_bits long`` and ``component_id long``: the smallest id that the row reaches
    through links of at most ``distance`` bits, itself included. Texts are read once and never
    shuffled.

    Copies share a fingerprint and take part once; links are found between distinct fingerprints.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Texts of one
    or two words are one shingle. A row without an id gets the smallest id of its group, or null if
    the group has none. Repeated rows stay. Empty tables give empty results. Other columns of
    ``docs`` are not read.
    """
    return _grouped(docs, id_column, text_column, distance, n_blocks, bucket_limit).select(id_column, "row_digest", "fingerprint_bits", "component_id")


def _grouped(docs: DataFrame, id_column: str, text_column: str, distance: int = 3, n_blocks: int = 5, bucket_limit: int = 100) -> DataFrame:
    """``with_components`` and ``root long``, the group's smallest fingerprint, which no other group has."""
    ship(docs.sparkSession)
    hashed = F.pandas_udf(_fingerprints, "long")
    prints = docs.select(F.col(id_column), row_key(id_column, text_of(text_column)).alias("row_digest"), hashed(text_of(text_column)).alias("fingerprint_bits"))
    prints = materialize(prints, "fingerprints")
    groups = print_components(prints.select(F.col(id_column).cast("long").alias("id"), F.col("fingerprint_bits").alias("fp")), distance, n_blocks, bucket_limit)
    return prints.join(groups, "fingerprint_bits").select(id_column, "row_digest", "fingerprint_bits", "component_id", "root")


def print_components(prints: DataFrame, distance: int, n_blocks: int, bucket_limit: int) -> DataFrame:
    """Maps each distinct fingerprint of ``prints`` (id long, fp long) to its group's smallest id and smallest fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    links = connected_components(similar_pairs(distinct, distance, n_blocks, bucket_limit))
    rooted = materialize(distinct.join(links, distinct["fp"] == links["node"], "left").select("fp", "least", "root"), "rooted")
    roots = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("top"))
    linked = rooted.where("root is not null").join(roots, "root").select(F.col("fp").alias("fingerprint_bits"), F.col("top").alias("component_id"), "root")
    return linked.union(rooted.where("root is null").select("fp", "least", "fp"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    The row whose id is the group's smallest stays. Where ids repeat or are null, one of the rows
    with the smallest digest stays, and equal rows become one. Groups are told apart by fingerprint,
    so those without ids, or that share an id, each keep a row.
    """
    return _first_of_each(docs, _grouped(docs, id_column, text_column, **settings), id_column, text_column)


def _first_of_each(docs: DataFrame, groups: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The row with the smallest id, then digest, of each ``root`` of ``groups``."""
    c = own_columns(docs, "order", "digest")
    ordered = groups.select(id_order(id_column).alias(c["order"]), F.col("row_digest").alias(c["digest"]), "root")
    chosen = ordered.groupBy("root").agg(F.min(F.struct(c["order"], c["digest"])).alias("row")).select("row.*")
    marked = docs.withColumns({c["order"]: id_order(id_column), c["digest"]: row_key(id_column, text_of(text_column))})
    found = marked.join(chosen, [c["order"], c["digest"]], "left_semi")
    # Equal rows share id and digest; only then is there more than one row to a key.
    return found.dropDuplicates([c["order"], c["digest"]]).select(*docs.columns)


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    """The shingles of some words, joined by blanks; all words if they are fewer."""
    whole = b" ".join(words)
    if len(words) <= size:
        return [whole]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return [whole[a:b] for a, b in zip((ends - sizes)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same pieces for each seed, by the splitmix64 steps; for seed 0 the hashes themselves."""
    if not seed:
        return hashes
    z = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _set_of(words: list[bytes]) -> np.ndarray:
    """Hashes of the different shingles of five words, ascending."""
    pieces = _shingles(words, SHINGLE)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64, len(pieces)))


def _long_print(hashes: np.ndarray) -> tuple[list[int], int]:
    """SimHash of 64 bits for each of ``LONGS`` seeds, and a hash of the set."""
    out = []
    for seed in range(LONGS):
        mixed = _mixed(hashes, seed)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 15):
            ones += np.unpackbits(mixed[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(mixed)).view(">i8")[0]))
    return out, xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _block_keys(hashes: np.ndarray) -> list[int]:
    """A key for each block: the least of the pieces in ``BLOCK_PIECES`` orders, hashed together."""
    orders = BLOCKS * BLOCK_PIECES
    least = np.full(orders, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12), None]
        z = (part ^ _SALTS) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0x94D049BB133111EB)
        np.minimum(least, z.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BLOCKS, BLOCK_PIECES))]


def _set_prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            hashes = _set_of((text or "").encode("utf-8", "surrogatepass").lower().split())
            prints, key = _long_print(hashes)
            rows.append((_block_keys(hashes), prints, len(hashes), key))
        yield pd.DataFrame(rows, columns=["blocks", "prints", "n", "key"])


def widest(n_a: Column, n_b: Column, bits: int = 64 * LONGS, similarity: float = SIMILARITY) -> Column:
    """Bits by which long fingerprints of two sets of so many shingles differ if their similarity is ``similarity``.

    Sets A and B of similarity s share s (a + b) / (1 + s) shingles; their fingerprints differ in the
    share of bits that the angle between them is of a half turn.
    """
    shared = (n_a + n_b) * similarity / (1 + similarity)
    return F.acos(F.least(F.lit(1.0), shared / F.sqrt(n_a * n_b))) / math.pi * bits


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups texts whose sets of five-word shingles are similar (Jaccard) by 0.8 or more, directly or through others.

    Returns for each row ``id_column, row_digest long, set_key long, root long``: a hash of the text's
    set of shingles and the smallest ``set_key`` of its group.

    Pairs at 0.8 differ in about 10 of 64 bits of a SimHash, which no number of its blocks finds at
    a bearable cost. So a block here is not a run of bits but ``BLOCK_PIECES`` shingles, the least
    in orders of its own: two sets agree in one with probability 0.8 ** 5 at least, and in none of
    ``BLOCKS`` with 3 in a million. Pairs of a block are verified by the Hamming distance of
    fingerprints of 512 bits against the distance that a similarity of 0.8 has; within three standard
    errors of it the shingles of both texts are compared, unless surer links join them. Texts of one
    set take part once.

    A block first compares its sets with two hubs: the one that is in the largest blocks, which is
    the least edited of many near copies, and the first. The others are described by what they differ in
    from the shingles that most sets of the hub's blocks hold (``_differences``). Those that differ in
    little are linked without a comparison (``_certain_links``); of the rest, pairs are made that are in
    different components and differ from most in the same rare places (``_further_pairs``). Neither loses a pair.

    A-Z is lower-cased. Shorter texts are one shingle; null, empty and blank texts are one group; very
    long texts are read whole, in steps of bounded memory. Rows without an id take part like others;
    other columns are not read; empty tables give empty results.
    """
    ship(docs.sparkSession)
    udf = F.pandas_udf(_set_prints, "blocks array<long>, prints array<long>, n int, key long")
    rows = docs.select(F.col(id_column), row_key(id_column, text_of(text_column)).alias("row_digest"), udf(text_of(text_column)).alias("p"))
    rows = materialize(rows.select(id_column, "row_digest", F.inline(F.array("p"))).withColumnRenamed("key", "set_key"), "set-prints")
    sets = materialize(rows.groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("blocks", "prints", "n")]), "shingle-sets")
    buckets = _buckets(sets)
    stars = None
    for hub in ("hub", "other_hub"):
        own = buckets.where(F.col("set_key") != F.col(hub)).select(F.least("set_key", hub).alias("key_a"), F.greatest("set_key", hub).alias("key_b"))
        stars = own if stars is None else stars.union(own)
    prints = sets.select("set_key", "prints", "n")
    pairs = stars.distinct()
    for x in "ab":
        pairs = pairs.join(prints.toDF(f"key_{x}", f"prints_{x}", f"n_{x}"), f"key_{x}")
    judged = _judged(pairs.where(_near()), "similar-to-hubs")
    first = materialize(connected_components(_edges(judged.where("sure"))), "first-components")
    # Then the sets of a hub's blocks that are in different components are told apart by what they differ in.
    placed = _with_roots(buckets.select("bucket", "set_key", "hub"), first)
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    groups = materialize(placed.join(mixed, "bucket", "left_semi").select("hub", "set_key").distinct(), "mixed-groups")
    drop_table(buckets)
    differences = _differences(docs, rows, groups, id_column, text_column)
    certain = materialize(_certain_links(differences), "certain-links")
    joined = materialize(connected_components(_edges(judged.where("sure")).union(certain)), "second-components")
    near = materialize(_further_pairs(differences, joined), "further-pairs")
    drop_table(differences)
    for x in "ab":
        near = near.join(prints.toDF(f"key_{x}", f"prints_{x}", f"n_{x}"), f"key_{x}")
    second = _judged(near.where(_near()), "similar-sets")
    sure = connected_components(_edges(judged.where("sure").union(second.where("sure"))).union(certain))
    # Pairs near the edge that sure links don't join are counted exactly.
    open_pairs = judged.union(second).where("NOT sure")
    for x in "ab":
        own = sure.select(F.col("node").alias(f"key_{x}"), F.col("root").alias(f"root_{x}"))
        open_pairs = open_pairs.join(own, f"key_{x}", "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", f"key_{x}"))
    open_pairs = materialize(open_pairs.where("root_a <> root_b").select("key_a", "key_b", "root_a", "root_b"), "open-pairs")
    more = _verified(docs, rows, open_pairs, id_column, text_column)
    links = sure.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("root_a", "root_b"))
    roots = connected_components(links)
    found = rows.select(id_column, "row_digest", "set_key").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    return found.select(id_column, "row_digest", "set_key", F.coalesce("root", "set_key").alias("root"))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def _buckets(sets: DataFrame) -> DataFrame:
    """The blocks that several sets share: (bucket, set_key, hub, other_hub).

    A set's weight is how many sets its blocks hold. The hubs of a block are its heaviest set and its first.
    """
    keyed = sets.select("set_key", F.explode("blocks").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    shared = materialize(keyed.join(sizes, "bucket"), "shared-blocks")
    weights = shared.groupBy("set_key").agg(F.sum("held").alias("weight"))
    hubs = shared.join(weights, "set_key").groupBy("bucket").agg(F.max(F.struct("weight", "set_key")).alias("most"), F.min("set_key").alias("other_hub"))
    return materialize(shared.join(hubs, "bucket").select("bucket", "set_key", F.col("most.set_key").alias("hub"), "other_hub"), "block-hubs")


def _far() -> Column:
    return sum((F.bit_count(F.get("prints_a", F.lit(i)).bitwiseXOR(F.get("prints_b", F.lit(i)))) for i in range(LONGS)), F.lit(0))


def _edge() -> tuple[Column, Column]:
    """The distance in bits of two sets of these sizes at the similarity sought, and three standard errors of it."""
    edge = widest(F.col("n_a").cast("double"), F.col("n_b").cast("double"))
    return edge, 3 * F.sqrt(edge * (1 - edge / (64 * LONGS)))


def _near() -> Column:
    """Whether two sets may be similar, by their sizes and long fingerprints."""
    edge, margin = _edge()
    return (F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")) & (_far() <= edge + margin)


def _judged(pairs: DataFrame, name: str) -> DataFrame:
    """(key_a, key_b, sure) of pairs that are ``_near``: ``sure`` where the long fingerprints leave no doubt."""
    edge, margin = _edge()
    return materialize(pairs.select("key_a", "key_b", (_far() <= edge - margin).alias("sure")), name)


def _shingle_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        sets = []
        for text in texts:
            sets.append(_set_of((text or "").encode("utf-8", "surrogatepass").lower().split()).view(np.int64))
        yield pd.Series(sets, dtype="object")


def _members(docs: DataFrame, rows: DataFrame, keys: DataFrame, id_column: str, text_column: str, name: str) -> DataFrame:
    """(key, members) of the sets ``keys`` (set_key): their texts are read again, one for each set."""
    c = own_columns(docs, "order", "digest", "key")
    chosen = rows.join(keys, "set_key", "left_semi").groupBy("set_key").agg(F.min(F.struct(id_order(id_column).alias("order"), "row_digest")).alias("row"))
    chosen = chosen.select(F.col("row.order").alias(c["order"]), F.col("row.row_digest").alias(c["digest"]), F.col("set_key").alias(c["key"]))
    marked = docs.select(id_order(id_column).alias(c["order"]), row_key(id_column, text_of(text_column)).alias(c["digest"]), text_of(text_column).alias("text"))
    texts = marked.join(chosen, [c["order"], c["digest"]]).dropDuplicates([c["key"]])
    return materialize(texts.select(F.col(c["key"]).alias("key"), F.pandas_udf(_shingle_sets, "array<long>")("text").alias("members")), name)


def _with_roots(sets: DataFrame, components: DataFrame) -> DataFrame:
    """``sets`` with the ``root`` of each ``set_key``, itself if it has no links."""
    return sets.join(components.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))


def _differences(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """What each set of ``groups`` (hub, set_key) differs in from its group: (hub, set_key, n, places, excess).

    A group's common shingles are those that over half of its sets hold. ``places`` are the shingles that
    the set holds and that are not common, and the common ones that it lacks: first those that at most one set
    in ``KNOWN`` of the group differs in, then the others, the rarest first. So all sets of a group have them in one order.
    The shingles that are ranked are at most ``KNOWN`` times as many as a set of the group holds on average.

    Sets A and B of n and m shingles with differences D and E have ``|D| + |E| - 2 |D and E|`` shingles that
    one of them lacks; they are similar if these are at most (1 - s) / (1 + s) of n + m. ``excess`` is
    ``WEIGHT * |D| - n``, so that this is ``excess_A + excess_B <= 2 * WEIGHT * |D and E|``, in whole numbers.
    """
    keys = groups.select("set_key").distinct()
    members = _members(docs, rows, keys, id_column, text_column, "group-sets").toDF("set_key", "own")
    held = groups.join(members, "set_key")
    counts = held.select("hub", F.explode("own").alias("piece")).groupBy("hub", "piece").agg(F.count("*").alias("f")).where("f > 1")
    known = counts.join(groups.groupBy("hub").agg(F.count("*").alias("sets")), "hub").where(F.col("f") * KNOWN > F.col("sets"))
    ranked = F.struct(F.least("f", F.col("sets") - F.col("f")).alias("rarity"), "piece", (2 * F.col("f") > F.col("sets")).alias("most"))
    known = known.groupBy("hub").agg(F.array_sort(F.collect_list(ranked)).alias("known"))
    known = known.select("hub", F.col("known.piece").alias("known"), F.filter("known", lambda x: x["most"])["piece"].alias("common"))
    none = F.array().cast("array<long>")
    held = held.join(known, "hub", "left").withColumns({"known": F.coalesce("known", none), "common": F.coalesce("common", none)})
    held = held.withColumn("differ", F.concat(F.array_except("own", "common"), F.array_except("common", "own")))
    places = F.concat(F.array_except("differ", "known"), F.array_intersect("known", "differ"))
    n, excess = F.size("own"), WEIGHT * F.size("differ") - F.size("own")
    return materialize(held.select("hub", "set_key", n.cast("long").alias("n"), places.alias("places"), excess.cast("long").alias("excess")), "group-differences")


def _least_excess(differences: DataFrame) -> DataFrame:
    least = differences.groupBy("hub").agg(F.min(F.struct("excess", "set_key")).alias("least"))
    return least.select("hub", F.col("least.excess").alias("least"), F.col("least.set_key").alias("core"))


def _certain_links(differences: DataFrame) -> DataFrame:
    """Links (a, b) of each set to the set of its group that differs least, where the two are similar wherever their differences are.

    Two sets of a group that are similar by their numbers of differences alone are both linked to it.
    """
    found = differences.select("hub", "set_key", "excess").join(_least_excess(differences), "hub")
    return found.where((F.col("set_key") != F.col("core")) & (F.col("excess") + F.col("least") <= 0)).select(F.col("set_key").alias("a"), F.col("core").alias("b")).distinct()


def _further_pairs(differences: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs (key_a, key_b) of a group that may be similar, are in different components and aren't certain.

    They have ``need = (excess_A + excess_B) / (2 * WEIGHT)`` differences in common, one at least, so by the
    prefix rule they share one that has ``need - 1`` others after it in both. A place's ``reach`` is the
    largest excess of a partner for which it has. A place takes part if sets of several components have it
    and its set and some set of the place are in reach of each other. Near copies of one text that differ from it in places of their own
    so make no pairs, however many they are.
    """
    rooted = _with_roots(differences.join(_least_excess(differences).select("hub", "least"), "hub"), components)
    entries = rooted.select("hub", "set_key", "root", "n", "excess", "least", F.size("places").alias("size"), F.posexplode("places").alias("at", "piece"))
    reach = 2 * WEIGHT * (F.col("size") - F.col("at")) - F.col("excess")
    entries = entries.withColumn("reach", reach).where("reach >= least").select("hub", "piece", "set_key", "root", "n", "excess", "reach")
    entries = materialize(entries, "places")
    bounds = entries.groupBy("hub", "piece").agg(F.min("root").alias("root_1"), F.max("root").alias("root_2"), F.min("excess").alias("low"), F.max("reach").alias("high"))
    kept = entries.join(bounds.where("root_1 <> root_2").select("hub", "piece", "low", "high"), ["hub", "piece"]).where("reach >= low AND excess <= high")
    kept = materialize(kept.drop("low", "high"), "shared-places")
    drop_table(entries)
    left, right = (kept.toDF(*[f"{c}_{x}" for c in kept.columns]) for x in "ab")
    sizes = F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b") - 1e-9
    fits = F.expr("set_key_a < set_key_b AND root_a <> root_b AND excess_a <= reach_b AND excess_b <= reach_a") & sizes
    both = (F.col("hub_a") == F.col("hub_b")) & (F.col("piece_a") == F.col("piece_b"))
    return left.join(right, both & fits).select(F.col("set_key_a").alias("key_a"), F.col("set_key_b").alias("key_b")).distinct()


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The ``pairs`` (key_a, key_b, ...) whose sets have a Jaccard similarity of ``SIMILARITY`` at least."""
    keys = pairs.select(F.col("key_a").alias("set_key")).union(pairs.select("key_b")).distinct()
    sets = _members(docs, rows, keys, id_column, text_column, "compared-sets")
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("key").alias(f"key_{x}"), F.col("members").alias(f"members_{x}")), f"key_{x}")
    both = F.size(F.array_intersect("members_a", "members_b"))
    return pairs.where(both / (F.size("members_a") + F.size("members_b") - both) >= SIMILARITY)


def keep_similar_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """One document of each group of ``similar_groups``, with the columns of ``docs``; which one is as in ``keep_one``."""
    return _first_of_each(docs, similar_groups(docs, id_column, text_column, **settings), id_column, text_column)
