"""Packing of documents into sequences of equal length: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document gives whole windows of its own
first; its rest goes into the open window that it fills best. When none has room, the fullest window
is topped up with the head of the rest and emitted, and what is left of the rest is placed in turn.
At the end the open windows of a partition are merged into full ones, and the last one of each
partition, less than a window, is merged with those of other partitions.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, ship, text_of

WINDOW = 2048
#: Windows that a partition keeps open.
OPEN = 64
#: The id that ends every document.
END = 1
#: Partitions whose last windows are merged together; a group of them is one small task.
MERGED_PARTS = 256
#: Words whose ids a Python worker keeps.
KEPT = 500_000
#: The last character that is taken the fast way: up to it, lower-casing stays among the letters up to it.
ONE_CASE_TABLE = 0x17F
#: The splitting pattern of which the fast way is a copy with explicit classes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece(NamedTuple):
    """A run of a document's ids: 4 bytes each, little-endian."""

    doc: object
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first ``n`` ids and the others."""
        return self.part(0, n), self.part(n, self.length)

    def part(self, begin: int, end: int) -> Piece:
        return self._replace(start=self.start + begin, ids=self.ids[4 * begin : 4 * end])


class Packer:
    """The open windows of one partition. Methods return the windows they emit, as lists of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.rooms: list[tuple[int, int]] = []  # (free, number) ascending: the fullest window first
        self.pieces: dict[int, list[Piece]] = {}
        self.made = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        cuts = range(0, piece.length - self.window + 1, self.window)
        for at in cuts:
            yield [piece.part(at, at + self.window)]
        if cuts:
            piece = piece.part(len(cuts) * self.window, piece.length)
        while piece.length:
            at = bisect_left(self.rooms, (piece.length, -1))
            if at < len(self.rooms):
                yield from self._put(at, piece)
                return
            if len(self.rooms) < self.most_open:
                self.made += 1
                self.pieces[self.made] = [piece]
                insort(self.rooms, (self.window - piece.length, self.made))
                return
            head, piece = piece.cut(self.rooms[0][0])
            yield from self._put(0, head)

    def _put(self, at: int, piece: Piece) -> Iterator[list[Piece]]:
        free, number = self.rooms.pop(at)
        self.pieces[number].append(piece)
        if free == piece.length:
            yield self.pieces.pop(number)
        else:
            insort(self.rooms, (free - piece.length, number))

    def merge(self) -> Iterator[list[Piece]]:
        """Tops up the fullest windows from the emptiest until one is left open at most."""
        while len(self.rooms) > 1:
            _, emptiest = self.rooms.pop()
            for piece in self.pieces.pop(emptiest):
                while piece.length and self.rooms:
                    head, piece = piece.cut(min(piece.length, self.rooms[0][0]))
                    yield from self._put(0, head)
                if piece.length:  # every other window is full by now
                    self._reopen(piece)

    def _reopen(self, piece: Piece) -> None:
        self.made += 1
        self.pieces[self.made] = [piece]
        self.rooms = [(self.window - piece.length, self.made)]

    def last(self) -> list[Piece]:
        """The pieces of the window that ``merge`` leaves open."""
        return [p for pieces in self.pieces.values() for p in pieces]


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cuts less than a window into sequences whose lengths are powers of two: these need no padding."""
    left = sum(p.length for p in pieces)
    rest = list(reversed(pieces))
    while left:
        room = size = 1 << (left.bit_length() - 1)
        held = []
        while room:
            piece = rest.pop()
            if piece.length > room:
                piece, over = piece.cut(room)
                rest.append(over)
            held.append(piece)
            room -= piece.length
        left -= size
        yield held


class WordCoder:
    """Ids of whole texts without their decoded form.

    Words met before are kept; a full store is emptied and filled again. Texts of letters up to
    ``ONE_CASE_TABLE`` alone, which no composition changes, are split by a pattern of explicit
    classes, made from what the tokenizer's own pattern does with each of these characters.
    """

    def __init__(self, spec: str):
        self.coder = bpe.WordBpe(spec)
        self.known: dict[str, bytes] = {}
        self._wide = re.compile(f"[^\\x00-{chr(ONE_CASE_TABLE)}]")
        self._split = None
        if self.coder._split.pattern == PATTERN:
            own = self.coder._split.findall
            kinds: dict[str, list[str]] = {"letter": [], "number": [], "space": []}
            for c in map(chr, range(ONE_CASE_TABLE + 1)):
                kind = "space" if not own(c) else "letter" if own("a" + c) == ["a" + c] else "number" if len(own("!" + c)) == 2 else None
                if kind:
                    kinds[kind].append(re.escape(c))
            letter, number, space = map("".join, kinds.values())
            self._split = re.compile(f"[{letter}]+|'(?:[stmd]|re|ve|ll)|[{number}]|[^{letter}{number}{space}]+")

    def runs(self, text: str) -> list[list[str] | str]:
        """Runs of words, and special tokens as strings of their own."""
        if self._split is None or "<|" in text or self._wide.search(text):
            return list(self.coder.words(text))
        return [self._split.findall(text.lower())]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian 32-bit integers; what is new in them is encoded together."""
        split = [self.runs(text) for text in texts]
        need: set[str] = set()
        for runs in split:
            for run in runs:
                if isinstance(run, list):
                    need.update(run)
        if len(self.known) + len(need) > KEPT:
            self.known.clear()
        new = list(need - self.known.keys())
        if new:
            ids, sizes = self.coder.merge(new)
            raw, at = ids.astype("<u4").tobytes(), 0
            for word, n in zip(new, (4 * sizes).tolist()):
                self.known[word] = raw[at : at + n]
                at += n
        known, special = self.known, self.coder.special
        for runs in split:
            yield b"".join(special[r].to_bytes(4, "little") if isinstance(r, str) else b"".join([known[w] for w in r]) for r in runs)


_coders: dict[str, WordCoder] = {}


def _coder(spec: str) -> WordCoder:
    if spec not in _coders:
        _coders.clear()
        _coders[spec] = WordCoder(spec)
    return _coders[spec]


def _groups(texts: list[str], chars: int = 1 << 24) -> Iterator[list[int]]:
    """Numbers of successive texts that together have about ``chars`` characters."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Rows:
    """Collects pieces as columns of an Arrow batch."""

    def __init__(self, id_type: pa.DataType, with_ids: bool):
        self.id_type, self.with_ids = id_type, with_ids
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[Piece], sequence_id: int | None) -> None:
        offset = 0
        for p in pieces:
            kept = p.ids if self.with_ids or sequence_id is None else None
            self.rows.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, sequence_id, offset, kept))
            offset += p.length

    def take(self, part: int | None = None) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 8
        kinds = [self.id_type, *[pa.int64()] * 6, pa.binary()]
        names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        if part is not None:
            arrays.append(pa.array([part] * len(self.rows), pa.int64()))
            names.append("part")
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, most_open: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Packs the token ids of all documents into sequences of at most ``window`` (a power of two) ids.

    A document is its text's ids and the id ``END``. Returns a row for each piece: ``id_column,
    start, length, ids_crc32, doc_tokens, sequence_id, offset`` (all long); ``start`` counts the
    document's ids before the piece, ``offset`` those of the sequence before it. With ``with_ids``
    the piece's own ids follow as ``ids array<int>``.

    Sequences are full, but for at most ``log2(window)`` in every ``MERGED_PARTS`` partitions: what
    is left there is cut at powers of two, which aren't padded. Documents never move between
    partitions, only the less than one window that each partition has left does. A partition holds
    ``most_open`` windows and one group of texts, whatever its size. All pieces are written once, so
    a lost executor repeats only its own partitions.

    Null and empty texts are documents of the id ``END`` alone; repeated rows and rows without an id
    are documents of their own; very long texts fill windows of their own and their rest is
    placed like any other; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(bpe.read_spec(spark, tokenizer_path))
    rows = docs.select(F.col(id_column).alias("doc"), text_of(text_column).alias("text"))
    id_kind = rows.schema["doc"].dataType.simpleString()
    end = END.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, part, made, out = _coder(spec.value), Packer(window, most_open), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            out = out or _Rows(batch.column(0).type, with_ids)
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _groups(texts):
                for i, raw in zip(group, coder.encode([texts[i] for i in group])):
                    whole = raw + end
                    for sequence in packer.add(Piece(ids[i], 0, whole, len(whole) // 4)):
                        out.sequence(sequence, part << 32 | made)
                        made += 1
                yield out.take(part)
        for sequence in packer.merge():
            out.sequence(sequence, part << 32 | made)
            made += 1
        if out:
            out.sequence(packer.last(), None)
            yield out.take(part)

    pieces = materialize(rows.mapInArrow(packed, f"doc {id_kind}, {PIECES}, ids binary, part long"), "packed-pieces")

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        packer, made, out = Packer(window, most_open), 0, _Rows(table.schema.field("doc").type, with_ids)
        base = 1 << 62 | key[0].as_py() << 32
        # Every partition's rest comes whole, in the order of partitions and offsets.
        for row in table.sort_by([("part", "ascending"), ("offset", "ascending")]).to_pylist():
            for sequence in packer.add(Piece(row["doc"], row["start"], row["ids"], row["doc_tokens"])):
                out.sequence(sequence, base | made)
                made += 1
        for sequence in (*packer.merge(), *powers(packer.last())):
            out.sequence(sequence, base | made)
            made += 1
        return pa.Table.from_batches([out.take()])

    rest = pieces.where("sequence_id IS NULL").withColumn("together", F.floor(F.col("part") / MERGED_PARTS).cast("long"))
    rest = rest.groupBy("together").applyInArrow(merged, f"doc {id_kind}, {PIECES}, ids binary")
    out = pieces.where("sequence_id IS NOT NULL").drop("part").union(rest)
    columns = [F.col("doc").alias(id_column), *PIECES.replace(" long", "").split(", ")]
    return out.select(*columns, F.pandas_udf(_numbers, "array<int>")("ids").alias("ids")) if with_ids else out.select(*columns)


def _numbers(ids: pd.Series) -> pd.Series:
    """Little-endian 4-byte integers as arrays."""
    return pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], dtype="object")
