import random
import struct
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest

from evenkeel.llm import packing as P
from evenkeel.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(PATH)
    coder.no_truncation()
    coder.no_padding()
    return lambda text: [*coder.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, library, window):
    """Every document's ids lie in its pieces once, every sequence is gapless and needs no padding."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"], r["doc_tokens"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
    want = sorted((str(i), n) for i, t in texts for n in library(t))
    assert sorted((str(r["doc_id"]), n) for r in rows for n in r["ids"]) == want
    for r in rows:
        assert len(r["ids"]) == r["length"] > 0 and zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"]
    whole = defaultdict(list)
    for i, t in texts:
        whole[i].append(library(t))
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    for i, ids in whole.items():
        if len(ids) == 1:
            pieces = sorted(by_id[i], key=lambda r: r["start"])
            assert [n for r in pieces for n in r["ids"]] == ids[0] and {r["doc_tokens"] for r in pieces} == {len(ids[0])}
            assert [r["start"] for r in pieces] == [*accumulate((r["length"] for r in pieces), initial=0)][:-1]
    short = 0
    for pieces in of_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [*accumulate((r["length"] for r in pieces), initial=0)][:-1]
        size = sum(r["length"] for r in pieces)
        assert size <= window and size & (size - 1) == 0
        short += size < window
    assert short <= window.bit_length()


@pytest.mark.parametrize("window,most_open", [(2048, 64), (64, 3), (1, 1), (256, 1)])
def test_every_id_once(docs, doc_rows, library, window, most_open):
    rows = P.pack_documents(docs, PATH, window=window, most_open=most_open, with_ids=True).collect()
    check(rows, [r[:2] for r in doc_rows], library, window)


def test_digests_are_those_of_the_ids_and_names_clash(docs, clashing, empty):
    columns = ["doc_id", *P.PIECES.replace(" long", "").split(", ")]
    plain = P.pack_documents(docs, PATH)
    assert plain.columns == columns and P.pack_documents(empty, PATH).count() == 0
    assert sorted(map(str, plain.collect())) == sorted(map(str, P.pack_documents(clashing, PATH).collect())) == sorted(map(str, P.pack_documents(docs, PATH, with_ids=True).drop("ids").collect()))


def test_ids_that_no_double_holds(spark, library):
    big = (1 << 60) + 1
    rows = P.pack_documents(spark.createDataFrame([(big, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert {r["doc_id"] for r in rows} == {big, None}


def test_windows_stay_bounded_and_fit_best():
    rng = random.Random(5)
    packer, out, total = P.Packer(100, 4), [], 0
    for i in range(500):
        n = rng.choice([1, 7, 30, 55, 99, 100, 250])
        total += n
        out += packer.add(P.Piece(i, 0, bytes(4 * n), n))
        assert len(packer.rooms) <= 4 and sorted(packer.rooms) == packer.rooms and set(packer.pieces) == {x for _, x in packer.rooms}
    assert all(sum(p.length for p in s) == 100 for s in out)
    out += packer.merge()
    assert len(packer.rooms) <= 1 and all(sum(p.length for p in s) == 100 for s in out)
    rest = packer.last()
    tail = [sum(p.length for p in s) for s in P.powers(rest)]
    assert sum(tail) == sum(p.length for p in rest) == total - 100 * len(out) and len(set(tail)) == len(tail)
    best = P.Packer(100, 8)
    for n in (60, 75, 30):  # 30 goes where 40 is free, then 25 fills the other
        assert not list(best.add(P.Piece(n, 0, bytes(4 * n), n)))
    assert [[p.doc for p in s] for s in best.add(P.Piece(25, 0, bytes(100), 25))] == [[75, 25]] and best.rooms[0][0] == 10


def test_fast_splitting_is_the_library_s(library):
    coder = P.WordCoder(open(PATH, encoding="utf-8").read())
    assert coder._split is not None
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x1A0)] + ["'s", "'ll", "'Re", "<|endoftext|>", "Σ", "é", "日", "½"]
    for k in range(3000):
        text = "".join(rng.choice(letters if k % 2 else letters[:128]) for _ in range(rng.randint(0, 30)))
        raw = next(iter(coder.encode([text])))
        assert [*struct.unpack(f"<{len(raw) // 4}I", raw), 1] == library(text), repr(text)
