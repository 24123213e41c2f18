"""Divergence of sources within a language, by a heavy-light split of the terms.

Every group (language and source) gives each kept term a smoothed share p, an integer. The distance of
two groups is the sum of |p - q| over all kept terms. Terms in many groups are heavy: tiles of them are
dense NumPy arrays, compared column by column. The others are light: every pair of groups begins with
what it would be if no light term occurred, each group's own light counts move that, and where a
term occurs in both groups a correction is added. All sums are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, own_columns, ship

#: Documents of a language that must hold a term, occurrences added to each count, the unit of p.
MIN_DOCS, SMOOTHING, UNIT = 30, 5, 1_000_000_000
#: Terms of a group that the report lists.
TOP_TERMS = 50
#: Terms of a dense tile, and groups in each of its two blocks: 8 bytes times both is its memory.
TILE_TERMS, TILE_GROUPS = 256, 256
#: Different terms that a task counts before it passes the counts on.
COUNTED = 300_000
#: Groups up to which the tables of a row for each group or language are broadcast.
MOST_SENT = 100_000

_SEPARATORS = bytes(0x20 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, with A-Z lower-cased.

    All bytes of characters beyond ASCII are above 0x7F, so a table of bytes does it.
    """
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group.

    A task counts before rows move: it passes on at most a row for each term and group in every
    ``COUNTED`` counts, and Spark adds them.
    """
    ship(docs.sparkSession)
    most = COUNTED
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[dict, dict]] = {}
        size = 0
        for batch in batches:
            for group_lang, group_source, whole in zip(*(c.to_pylist() for c in batch.columns)):
                n, in_docs = held.setdefault((group_lang, group_source), ({}, {}))
                before = len(n)
                words = terms_of(whole)
                for w in words:
                    n[w] = n.get(w, 0) + 1
                for w in set(words):
                    in_docs[w] = in_docs.get(w, 0) + 1
                size += len(n) - before
                if size >= most:
                    yield from _counts(held)
                    held, size = {}, 0
        yield from _counts(held)

    made = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counts(held: dict[tuple[str, str], tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
    for (group_lang, group_source), (n, in_docs) in held.items():
        terms = [w.decode("utf-8", "surrogatepass") for w in n]
        columns = [pa.array([group_lang] * len(n), pa.string()), pa.array([group_source] * len(n), pa.string()), pa.array(terms, pa.string())]
        columns += [pa.array(list(n.values()), pa.int64()), pa.array([in_docs[w] for w in n], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * terms)), exact for counts of any size."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + SMOOTHING)
    below = total.cast("decimal(19,0)") + F.lit(SMOOTHING).cast("decimal(1,0)") * terms.cast("decimal(18,0)")
    return 1 + F.call_function("div", top, below).cast("long")


class Shares:
    """The written tables that both parts of the audit read.

    ``groups`` (lang, source, g, v, n, p0): a number within the language, its kept terms, occurrences
    and the p of a term that the group hasn't. ``counts`` (lang, source, term, n, p, in_groups): p of the
    terms that it has, and how many groups have the term. ``terms`` (lang, term, q): the language's own p.
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, lang: str = "lang", source: str = "source", text: str = "text"):
        c = own_columns(docs, "lang", "source")
        every = docs.select(F.coalesce(F.col(lang), F.lit("")).alias(c["lang"]), F.coalesce(F.col(source), F.lit("")).alias(c["source"])).distinct().toDF("lang", "source")
        counted = materialize(term_counts(docs, lang, source, text), "term-counts")
        kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.count("*").alias("in_groups"))
        kept = materialize(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
        held = materialize(counted.join(kept.drop("all_n"), ["lang", "term"]).select("lang", "source", "term", "n", "in_groups"), "kept-counts")
        whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
        own = held.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = every.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["n", "v", "lang_n"])
        groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        nothing = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0)
        self.groups = materialize(groups.select("lang", "source", "g", "v", "n", nothing.alias("p0")), "audit-groups")
        few = self.groups.count() <= MOST_SENT
        self.sent = F.broadcast if few else lambda table: table
        totals = self.groups.select("lang", "source", "g", "v", F.col("n").alias("total"), "p0")
        self.counts = materialize(held.join(self.sent(totals), ["lang", "source"]).select("lang", "source", "g", "term", "in_groups", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0"), "audit-counts")
        self.terms = kept.join(self.sent(whole), "lang").select("lang", "term", "in_groups", share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"))


def light_limit(groups: Column) -> Column:
    """Terms in more groups than this are heavy. A light term gives no more pairs of groups than there are groups, or six."""
    return F.greatest(F.lit(4), F.floor(F.sqrt(groups))).cast("long")


def pair_distances(shares: Shares) -> DataFrame:
    """(lang, source, other, value) of all ordered pairs of different groups of a language.

    A light term's groups, at most ``light_limit``, meet in one row. A tile holds ``TILE_TERMS`` heavy
    terms and two blocks of ``TILE_GROUPS`` groups, so a task's memory is bounded whatever the numbers
    of terms and groups are; its sums are added by Spark.
    """
    sizes = shares.sent(shares.groups.groupBy("lang").agg(light_limit(F.count("*")).alias("limit"), F.count("*").alias("n_groups")))
    counts = shares.counts.join(sizes, "lang")
    light = counts.where("in_groups <= limit")
    # What a pair is if only one of its groups has a light term: the counts of p are enough.
    spread = light.groupBy("lang", "g", "p").agg(F.count("*").alias("n")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "n")).alias("own"))
    n_light = shares.terms.join(sizes, "lang").where("in_groups <= limit").groupBy("lang").agg(F.count("*").alias("n_light"))
    groups = materialize(shares.groups.select("lang", "source", "g", "p0").join(spread, ["lang", "g"], "left"), "audit-spread")

    def moved(own: str, p0: str, q0: str) -> Column:
        apart = F.abs(F.col(p0) - F.col(q0))
        return F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x["n"] * (F.abs(x["p"] - F.col(q0)) - apart)), F.lit(0))

    a, b = (groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "g", "p0", "own")]) for x in "ab")
    pairs = a.join(b, "lang").where("g_a < g_b").join(shares.sent(n_light), "lang", "left")
    alone = pairs.select(
        "lang",
        "g_a",
        "g_b",
        (F.coalesce("n_light", F.lit(0)) * F.abs(F.col("p0_a") - F.col("p0_b")) + moved("own_a", "p0_a", "p0_b") + moved("own_b", "p0_b", "p0_a")).alias("value"),
    )
    # Where both have it, the two moves go and the true distance comes.
    postings = light.where("in_groups > 1").groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p", "p0"))).alias("held"))
    first = postings.select("lang", "held", F.posexplode("held").alias("at", "x"))
    both = first.select("lang", "x", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("y"))
    p, q, p0, q0 = F.col("x.p"), F.col("y.p"), F.col("x.p0"), F.col("y.p0")
    shared = both.select("lang", F.col("x.g").alias("g_a"), F.col("y.g").alias("g_b"), (F.abs(p - q) - F.abs(p - q0) - F.abs(q - p0) + F.abs(p0 - q0)).alias("value"))
    parts = alone.union(shared.groupBy("lang", "g_a", "g_b").agg(F.sum("value").alias("value"))).union(_heavy(shares, counts.where("in_groups > limit"), sizes))
    one_way = parts.groupBy("lang", "g_a", "g_b").agg(F.sum("value").alias("value"))
    each = one_way.select("lang", F.explode(F.array(F.struct(F.col("g_a").alias("g"), F.col("g_b").alias("h")), F.struct(F.col("g_b").alias("g"), F.col("g_a").alias("h")))).alias("x"), "value").select("lang", "x.*", "value")
    names = shares.sent(shares.groups.select("lang", "g", "source"))
    return each.join(names, ["lang", "g"]).join(shares.sent(names.select("lang", F.col("g").alias("h"), F.col("source").alias("other"))), ["lang", "h"]).select("lang", "source", "other", "value")


def _heavy(shares: Shares, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, g_a, g_b, value): the heavy terms' sums for each pair of groups and tile."""
    heavy = shares.terms.join(sizes, "lang").where("in_groups > limit")
    terms = heavy.groupBy("lang").agg(F.count("*").alias("n_terms"))
    tiles = shares.sent(terms.select("lang", F.ceil(F.col("n_terms") / TILE_TERMS).alias("n_tiles")).join(sizes.select("lang", F.ceil(F.col("n_groups") / TILE_GROUPS).alias("n_blocks")), "lang"))
    width = TILE_GROUPS
    block = F.floor(F.col("g") / width)
    placed = counts.select("lang", "g", "p", "term").join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), "n_tiles"))
    # Every group is in every tile with its p of terms that it has not.
    bases = shares.groups.select("lang", "g", F.col("p0").alias("p"), F.lit(None).cast("string").alias("term")).join(tiles, "lang")
    in_tile = heavy.join(tiles, "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "n_tiles").alias("tile")).agg(F.count("*").alias("held"))
    bases = bases.join(in_tile, "lang")
    placed = placed.withColumn("held", F.lit(None).cast("long"))
    both = placed.unionByName(bases).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    keyed = both.select("lang", "tile", F.least(block, "other").alias("block_a"), F.greatest(block, "other").alias("block_b"), "g", "term", "p", "held")

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, block_a, block_b = (k.as_py() for k in key)
        g, p = table["g"].to_numpy(), table["p"].to_numpy()
        codes = table["term"].combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        base, known = codes < 0, codes >= 0
        members, where = np.unique(g, return_inverse=True)
        start = np.zeros(len(members), np.int64)
        start[where[base]] = p[base]
        dense = np.repeat(start[:, None], int(codes.max(initial=-1)) + 1, axis=1)  # a row for each group
        dense[where[known], codes[known]] = p[known]
        rows = members // width == block_a
        columns = members // width == block_b
        left, right, right_rows = members[rows], members[columns], dense[columns]
        # Terms of the tile that none of these groups has are no columns of the array.
        others = pc.max(table["held"]).as_py() - dense.shape[1]
        found = [np.abs(right_rows - dense[i]).sum(axis=1, dtype=np.int64) + others * np.abs(start[columns] - start[i]) for i in np.flatnonzero(rows)]
        g_a, g_b = np.repeat(left, len(right)), np.tile(right, len(left))
        value = np.concatenate(found) if found else np.zeros(0, np.int64)
        once = g_a < g_b
        return pa.table({"lang": pa.array([lang] * int(once.sum()), pa.string()), "g_a": pa.array(g_a[once], pa.int32()), "g_b": pa.array(g_b[once], pa.int32()), "value": pa.array(value[once], pa.int64())})

    return keyed.groupBy("lang", "tile", "block_a", "block_b").applyInArrow(compared, "lang string, g_a int, g_b int, value long")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """How far the sources of each language are apart, and by which terms each leaves its language.

    Returns ``lang, source, part, item, value long, rank int``. Part ``pair`` has each other source of the
    language with the sum of |p - q| over all kept terms; part ``term`` the ``top`` terms of the group whose
    p is above the language's. Ranks descend by value, ties by the item's bytes.

    Null and empty texts give no terms, null languages and sources are the empty string; groups without
    terms take part with p of zero counts; a language without kept terms has distances of 0. Repeated
    rows count each time, texts of any length are counted whole, other columns are not read; an empty
    table gives no rows.
    """
    shares = Shares(docs, min_docs, lang, source, text)
    pairs = pair_distances(shares).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    above = shares.counts.select("lang", "source", "term", "p").join(shares.terms.select("lang", "term", "q"), ["lang", "term"]).where("p > q")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)), terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)]
    return ranked[0].union(ranked[1])
