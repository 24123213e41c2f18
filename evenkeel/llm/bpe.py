"""BPE encoding and decoding with a pair occurrence index.

The words of a partition that were not met before are merged together: an index maps each pair of
adjacent symbols to all its places, the lowest rank among the pairs present is applied at all its
places, and the lists of the pairs around them are updated, until no pair with a rank is left.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, text_of

#: Words whose encoding a Python worker keeps; beyond it the store is emptied and filled again.
CACHE_WORDS = 300_000
ENCODED = "n_tokens long, ids array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"

# Combining marks newer than Unicode 9 (and U+11930, which composes with one). The
# tables of the tokenizers library's normalizer end there, so it neither reorders nor composes them.
LATE_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85),
    (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)

# Code points that the regex module's newer tables count as letters or digits, and the
# tokenizers library, whose tables are older, as neither.
NOT_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)

# Capitals (first, last, first lower-case letter) that the tokenizers library lower-cases and Python doesn't know yet.
LATE_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _class_of(ranges) -> str:
    return "[" + "".join(f"{chr(r[0])}-{chr(r[1])}" for r in ranges) + "]"


_FROM = regex.compile("[\u0558-\U0010ffff]")  # holds all of these tables
_LATE = regex.compile(f"({_class_of(LATE_MARKS)})")
_NEWER = regex.compile(_class_of(NOT_LETTERS))
_CAPITALS = regex.compile(_class_of(LATE_CAPITALS))
_LOWERED = {x: low + x - first for first, last, low in LATE_CAPITALS for x in range(first, last + 1)}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, as its JSON file describes it.

    ``spec`` is the file's text. Supported are the settings of such files: NFC, white-space
    replacement and lower-casing, one splitting pattern, byte letters, and no decoder.
    """

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        steps = [n["type"] for n in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or data["decoder"] or data["post_processor"]:
            raise ValueError("unsupported tokenizer settings")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        # (left, right) -> (rank, merged id)
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(pattern)
        # The same pattern with the library's letters and digits, for the few texts where they differ.
        own = {kind: rf"[{kind}--{_class_of(NOT_LETTERS)}]" for kind in (r"\p{L}", r"\p{N}")}
        for kind, less in own.items():
            pattern = pattern.replace(f"[{kind}]", f"[{less}]")
        others = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{own[r'\p{L}']}{own[r'\p{N}']}]")
        self._split_newer = regex.compile(others, regex.V1)
        self.known: dict[str, tuple[bytes, str]] = {}
        made = {}
        for (a, b), (rank, c) in self.ranks.items():
            if made.get(c) is not None or made.get(a, -1) > rank or made.get(b, -1) > rank:
                raise ValueError("merges aren't in the order in which they build on each other")
            made[c] = rank
        # The same as arrays: ids of single bytes, inside and at the end of a word; pairs by code.
        letters = _byte_letters()
        self._inner = np.array([self.vocab[x] for x in letters], np.int64)
        self._last = np.array([self.vocab[x + self.end] for x in letters], np.int64)
        self._base = max(self.tokens) + 1
        self._parts = {rank: (a, b, c) for (a, b), (rank, c) in self.ranks.items()}
        codes = np.array([a * self._base + b for a, b in self.ranks] + [1 << 62], np.int64)
        order = np.argsort(codes)
        self._codes, self._rank_of = codes[order], np.array([r for r, _ in self.ranks.values()] + [-1], np.int64)[order]

    def normalize(self, text: str) -> str:
        if not text.isascii() and not _FROM.search(text):
            text = unicodedata.normalize("NFC", text)
        elif not text.isascii():
            parts = _LATE.split(text)  # every second part is a late mark, which nothing passes
            text = "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(parts)) if len(parts) > 1 else unicodedata.normalize("NFC", text)
            if _CAPITALS.search(text):
                text = text.translate(_LOWERED)
        # A capital sigma is lower-cased without regard to its place in the word.
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def words(self, text: str) -> Iterator[list[str] | str]:
        """Runs of words, and special tokens of the text as strings of their own."""
        parts = self._special.split(text) if self._special and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield part
            elif part:
                plain = self.normalize(part)
                newer = not plain.isascii() and _FROM.search(plain) and _NEWER.search(plain)
                yield (self._split_newer if newer else self._split).findall(plain)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merges all words together by the pair occurrence index.

        Returns the token ids one word after the other, and how many each word has. Words lie in
        flat arrays with a gap after each. ``places`` maps a pair's rank to the positions where the
        pair stands or stood; whether it still does is seen when its turn comes.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1) - 1
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        ids = self._inner[data]
        ids[ends - 1] = self._last[data[ends - 1]]
        ids[ends] = -1
        after = np.arange(1, len(ids) + 1)
        before = np.arange(-1, len(ids) - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Adds the pairs that begin at these positions to the index."""
            code = ids[at] * self._base + ids[after[at]]
            found = np.searchsorted(self._codes, code)
            hit = self._codes[found] == code
            rank, at = self._rank_of[found[hit]], at[hit]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cut = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for lo, hi in zip(cut, cut[1:]):
                r = int(rank[lo])
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(at[lo:hi])

        enter(np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)))
        while active:
            rank = heapq.heappop(active)
            left, right, merged = self._parts[rank]
            at = places.pop(rank)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[(ids[at] == left) & (ids[after[at]] == right)]
            if left == right and len(at) > 1:  # in a run, from the left
                taken, last = [], -1
                for i in np.unique(at).tolist():
                    if i != last:
                        taken.append(i)
                        last = int(after[i])
                at = np.array(taken)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone] = merged, -2
            after[at], before[beyond] = beyond, at
            ahead = before[at]
            enter(np.concatenate([at[ids[beyond] >= 0], ahead[(ahead >= 0) & (ids[ahead] >= 0)]]))
        alive = ids >= 0
        return ids[alive], np.add.reduceat(alive, ends - sizes).astype(np.int64)

    def learn(self, words: set[str]) -> None:
        """Encodes the words not met before."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        ids, sizes = self.merge(fresh)
        raw, said = ids.astype("<u4").tobytes(), list(map(self.tokens.__getitem__, ids.tolist()))
        at = 0
        for word, n in zip(fresh, sizes.tolist()):
            self.known[word] = (raw[4 * at : 4 * (at + n)], " ".join(said[at : at + n]))
            at += n

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text the ids as little-endian 32-bit integers and the decoded text.

        Texts are taken in groups of 200,000 words and more, unless one text has more, so
        memory does not grow with the partition.
        """
        group: list[list] = []
        held = 0
        for text in texts:
            runs = list(self.words(text))
            group.append(runs)
            held += sum(len(r) for r in runs if isinstance(r, list))
            if held > 200_000:
                yield from self._encoded(group)
                group, held = [], 0
        yield from self._encoded(group)

    def _encoded(self, group: list[list]) -> Iterator[tuple[bytes, str]]:
        need = {w for runs in group for r in runs if isinstance(r, list) for w in r}
        self.learn(need)
        known = self.known
        for runs in group:
            ids, said = [], []
            for run in runs:
                if isinstance(run, str):
                    ids.append(struct.pack("<I", self.special[run]))
                    said.append(run)
                else:
                    for word in run:
                        got = known[word]
                        ids.append(got[0])
                        said.append(got[1])
            yield b"".join(ids), " ".join(said)

    def decode(self, ids: list[int]) -> str:
        """The tokens of known ids, joined by blanks: these files have no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def _coder(spec: str) -> WordBpe:
    return WordBpe(spec)


def read_spec(spark: SparkSession, path: str) -> str:
    """The tokenizer's JSON, from any place that Spark reads or the driver's own disk."""
    if "://" not in path:
        with open(path, encoding="utf-8") as file:
            return file.read()
    return spark.read.text(path, wholetext=True).first()[0]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    Returns ``id_column, n_tokens long, ids array<int>, decoded string``; with ``digests``
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``
    (of the decoded UTF-8 text) take the place of the last two. Special tokens are not added, but
    their strings in a text become their ids, as the tokenizers library has it.

    The vocabulary, a few megabytes whatever the data, is broadcast. Each partition is encoded for
    itself. Null and empty texts give no tokens; repeated rows stay; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(spark, tokenizer_path))

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(spec.value)
        for texts in batches:
            rows = []
            for ids, said in coder.encode(texts.tolist()):
                if digests:
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()))
                else:
                    rows.append((len(ids) // 4, struct.unpack(f"<{len(ids) // 4}I", ids), said))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"])

    coded = F.pandas_udf(encoded, DIGESTS if digests else ENCODED)
    return docs.select(F.col(id_column), coded(text_of(text_column)).alias("_coded")).select(id_column, "_coded.*")


def decode_ids(coded: DataFrame, tokenizer_path: str, ids_column: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids. Null arrays give null; unknown ids are left out."""
    spark = coded.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(spark, tokenizer_path))

    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(spec.value)
        for rows in batches:
            yield pd.Series([None if r is None else coder.decode(list(r)) for r in rows], dtype="object")

    return coded.withColumn(output, F.pandas_udf(decoded, "string")(F.col(ids_column)))
