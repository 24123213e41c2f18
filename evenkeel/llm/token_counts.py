"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A document's pre-tokens are grouped to leaves of about ``LEAF_CHARS`` characters. Each leaf has its
characters and tokens, and the inner nodes of a binary tree the sums of their subtrees. An edit
finds its leaf by descending the tree; encoding starts again one leaf before it (the boundary
context) and ends where a new pre-token ends at an old leaf's end behind the edit. Only that region
is encoded, and only the sums above it change (all sums are added up again, without encoding, where
the number of leaves changes).

Trees are kept between calls as a column with a document's leaves, from which the sums follow:
``build_trees`` encodes whole texts once, ``apply_edits`` takes texts with trees and encodes what the
edits touch.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_columns, ship, text_of

LEAF_CHARS = 256
CACHE_WORDS = 300_000
#: Documents with edits up to which these are sent to the tasks.
MOST_EDITED = 100_000
LEAVES = "array<struct<chars:int,tokens:int>>"


class PieceCounter:
    """Counts the tokens of pre-tokens for a rank file and its splitting pattern."""

    def __init__(self, ranks_path_text: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks_path_text.splitlines()) if a}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            n = self.known[piece] = len(self.coder.encode_ordinary(piece))
        return n

    def leaves(self, text: str, at: int = 0) -> Iterator[tuple[int, int]]:
        """(characters, tokens) of the leaves from a pre-token's begin on."""
        count, chars, tokens = self.known.get, 0, 0
        for m in self.split.finditer(text, at):
            piece = m.group()
            n = count(piece)
            tokens += self.count(piece) if n is None else n
            chars += len(piece)
            if chars >= LEAF_CHARS:
                yield chars, tokens
                chars = tokens = 0
        if chars:
            yield chars, tokens


class SegmentTree:
    """Sums over leaves (characters, tokens) in two arrays; node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.n = len(leaves)
        self.size = 1
        while self.size < max(1, self.n):
            self.size *= 2
        pad = [0] * (self.size - self.n)
        self.chars = [0] * self.size + [c for c, _ in leaves] + pad
        self.tokens = [0] * self.size + [t for _, t in leaves] + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one if it lies behind), and where the leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if char - begin >= self.chars[node] and self.tokens[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def leaf(self, i: int) -> tuple[int, int]:
        return self.chars[self.size + i], self.tokens[self.size + i]

    def put(self, i: int, chars: int, tokens: int) -> None:
        """Sets one leaf and updates the sums above it."""
        node = self.size + i
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def replace(self, first: int, last: int, leaves: list[tuple[int, int]]) -> SegmentTree:
        """Leaves first to last (exclusive) give way to others; the tree is rebuilt only if their number changes."""
        if len(leaves) == last - first:
            for i, (c, t) in enumerate(leaves):
                self.put(first + i, c, t)
            return self
        all_leaves = [self.leaf(i) for i in range(self.n)]
        return SegmentTree([*all_leaves[:first], *leaves, *all_leaves[last:]])


class EditableDocument:
    """A text with its tree: that of the leaves given, or a new one."""

    def __init__(self, counter: PieceCounter, text: str, leaves: list[tuple[int, int]] | None = None):
        self.counter, self.text, self.encoded = counter, text, 0 if leaves is not None else len(text)
        self.tree = SegmentTree(list(counter.leaves(text)) if leaves is None else leaves)

    def leaves(self) -> list[tuple[int, int]]:
        return [self.tree.leaf(i) for i in range(self.tree.n)]

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens[1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces the characters from ``start`` to ``end``; returns how many characters were encoded again.

        Places outside the text are moved to its nearest end.
        """
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        tree = self.tree
        first, begin = tree.leaf_at(max(start - 1, 0))
        if first:  # a pre-token before the edit may have looked ahead into it
            first -= 1
            begin -= tree.leaf(first)[0]
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        # Ends of old leaves that lie wholly behind the edit, as places in the new text.
        last, old_end = tree.leaf_at(max(end - 1, 0)) if tree.n else (0, 0)
        old_end += tree.leaf(last)[0] if tree.n else 0
        last += 1
        leaves: list[tuple[int, int]] = []
        at = begin
        for chars, tokens in self.counter_leaves(text, begin, tree, last, old_end + shift, end + shift):
            leaves.append((chars, tokens))
            at += chars
        while last < tree.n and old_end + shift < at:
            old_end += tree.leaf(last)[0]
            last += 1
        if at == len(text):
            last = tree.n
        self.text = text
        self.tree = tree.replace(first, last, leaves) if tree.n else SegmentTree(leaves)
        self.encoded += at - begin
        return at - begin

    def counter_leaves(self, text: str, begin: int, tree: SegmentTree, last: int, target: int, behind: int) -> Iterator[tuple[int, int]]:
        """Leaves of ``text`` from ``begin`` to the first end of an old leaf that is a pre-token's end too."""
        count, chars, tokens = self.counter.count, 0, 0
        for m in self.counter.split.finditer(text, begin):
            piece = m.group()
            stop = m.end()
            chars += len(piece)
            tokens += count(piece)
            while last < tree.n and target < stop:
                target += tree.leaf(last)[0]
                last += 1
            if stop == target and stop >= behind:
                yield chars, tokens
                return
            if chars >= LEAF_CHARS:
                yield chars, tokens
                chars = tokens = 0
        if chars:
            yield chars, tokens


@lru_cache(maxsize=2)
def _counter(ranks: str, pattern: str) -> PieceCounter:
    return PieceCounter(ranks, pattern)


def join_edits(docs: DataFrame, edits: DataFrame, id_column: str = "doc_id", order_column: str = "seq") -> DataFrame:
    """Adds ``edits`` to ``docs`` from a table (id, order, start, end, text) with a row for each edit.

    Edits without an id, or of unknown documents, are left out; documents without edits get null. The
    documents stay where they are if ``MOST_EDITED`` documents at most have edits; else both sides move.
    """
    rows = edits.select(F.col(id_column).alias("_edit_id"), F.struct(F.col(order_column).alias("seq"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text").alias("e"))
    own = rows.groupBy("_edit_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))).alias("edits"))
    own = materialize(own, "edits-by-document")
    own = F.broadcast(own) if own.count() <= MOST_EDITED else own
    return docs.drop("edits").join(own, F.col(id_column) == F.col("_edit_id"), "left").drop("_edit_id")


def build_trees(docs: DataFrame, ranks: str, pattern: str, text_column: str = "text") -> DataFrame:
    """Adds ``tree`` (array<struct<chars int, tokens int>>, a document's leaves in order) and ``n_tokens long``.

    Null and empty texts have no leaves. Columns of these names are replaced, all others stay. Repeated
    rows stay; empty tables give empty results. ``ranks`` is the text of a rank file, broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((ranks, pattern))

    def built(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(*sent.value)
        for texts in batches:
            yield pd.Series([[{"chars": c, "tokens": t} for c, t in counter.leaves(text or "")] for text in texts], dtype="object")

    made = docs.withColumn("tree", F.pandas_udf(built, LEAVES)(text_of(text_column)))
    # Through the generator the tree is made once, however often the columns are read.
    kept = [x for x in made.columns if x not in ("tree", "n_tokens")]
    return made.select(*kept, F.inline(F.array(F.struct("tree")))).withColumn("n_tokens", tokens_of("tree"))


def tokens_of(tree: str) -> Column:
    """The tokens of a tree's root."""
    return F.aggregate(F.col(tree), F.lit(0).cast("long"), lambda a, leaf: a + leaf["tokens"])


def apply_edits(docs: DataFrame, ranks: str, pattern: str, text_column: str = "text", tree_column: str = "tree", edits_column: str = "edits") -> DataFrame:
    """Applies each row's edits to its text and tree.

    ``edits_column`` is an array<struct<start int, end int, text string>> of code points, end
    exclusive, applied in order, each to the text that the one before left. Null arrays, null
    replacements (empty) and null places (0) are allowed; places outside are moved to the nearest end.

    The text and the tree are replaced by the edited ones, and ``n_tokens, n_tokens_before, n_edits,
    chars_encoded_again`` (long) added; columns of these names are replaced and all others stay. Only
    what the edits touch is encoded: of rows without edits nothing goes to Python. A null tree is built
    first, which ``chars_encoded_again`` does not count. Repeated rows stay; empty tables give empty results.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((ranks, pattern))
    names = ["edited", "leaves", "n", "before", "again"]

    def applied(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = _counter(*sent.value)
        for texts, trees, all_edits in batches:
            rows = []
            for text, tree, own in zip(texts, trees, all_edits):
                doc = EditableDocument(counter, text, None if tree is None else [(x["chars"], x["tokens"]) for x in tree])
                before, again = doc.n_tokens, 0
                for e in own:
                    again += doc.edit(int(e["start"] or 0), int(e["end"] or 0), e["text"] or "")
                rows.append((doc.text, [{"chars": c, "tokens": t} for c, t in doc.leaves()], len(own), before, again))
            yield pd.DataFrame(rows, columns=names)

    c = own_columns(docs, "done")
    changed = F.coalesce(F.size(edits_column) > 0, F.lit(False)) | F.col(tree_column).isNull()
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    udf = F.pandas_udf(applied, f"edited string, leaves {LEAVES}, n long, before long, again long")
    # Rows without edits are handed in empty: an expression's condition doesn't keep rows out of Python.
    empty = F.array().cast(LEAVES)
    done = udf(F.when(changed, text_of(text_column)).otherwise(""), F.when(changed, F.col(tree_column)).otherwise(empty), F.when(changed, F.coalesce(F.col(edits_column), none)).otherwise(none))
    out = docs.withColumn(c["done"], done)
    got = F.col(c["done"])
    before = F.when(changed, got["before"]).otherwise(tokens_of(tree_column))
    counted = {"n_tokens_before": before, "n_edits": got["n"], "chars_encoded_again": got["again"]}
    new = {text_column: F.when(changed, got["edited"]).otherwise(F.col(text_column)), tree_column: F.when(changed, got["leaves"]).otherwise(F.col(tree_column))}
    kept = [x for x in docs.columns if x not in (*new, *counted, "n_tokens")]
    rows = out.select(*kept, F.inline(F.array(F.struct(*[x.alias(k) for k, x in (new | counted).items()]))))
    return rows.withColumn("n_tokens", tokens_of(tree_column))


def count_with_edits(docs: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", edits_column: str = "edits") -> DataFrame:
    """Builds the trees of whole texts, applies each row's edits to them and counts from both.

    Returns ``id_column, n_tokens, n_tokens_edited, n_edits, chars_encoded_again`` (long) and
    ``edited_text``. Nulls, edges and edits are as in ``apply_edits``, which builds the trees in the
    same pass; other columns are not read.
    """
    whole = docs.select(F.col(id_column), F.col(text_column), F.col(edits_column), F.lit(None).cast(LEAVES).alias("tree"))
    edited = apply_edits(whole, ranks, pattern, text_column, "tree", edits_column)
    return edited.select(id_column, F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_edits", "chars_encoded_again", text_of(text_column).alias("edited_text"))


def count_with_edit_table(docs: DataFrame, edits: DataFrame, ranks: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Builds and keeps the trees of whole texts, then applies a table of edits to the kept trees.

    ``edits`` is as in ``join_edits``. Returns ``id_column, n_tokens, n_tokens_edited, n_edits,
    chars_encoded_again`` (long) and ``edited_text``. The trees are written once, with their texts; documents
    without edits are counted from their kept trees alone.
    """
    kept = materialize(build_trees(docs.select(F.col(id_column), F.col(text_column)), ranks, pattern, text_column).drop("n_tokens"), "token-trees")
    edited = apply_edits(join_edits(kept, edits, id_column), ranks, pattern, text_column)
    return edited.select(id_column, F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_edits", "chars_encoded_again", text_of(text_column).alias("edited_text"))
