import hashlib
import struct

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evenkeel.llm import bpe

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.WordBpe(file.read())


def check(coder, texts):
    for text, (ids, said) in zip(texts, coder.encode(texts), strict=True):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert said == LIBRARY.decode(want, skip_special_tokens=False) == coder.decode(want)


def test_against_the_library(coder, doc_rows):
    check(coder, [r[1] or "" for r in doc_rows])


def test_every_code_point_splits_and_lowers_as_in_the_library(coder):
    points = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"a{chr(x)}b 1{chr(x)}! {chr(x)}\u0301A{chr(x)}" for x in points[at : at + 50_000]]
        want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        for text, (ids, _), own in zip(texts, coder.encode(texts), want, strict=True):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == own, ascii(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aabbthein 's't<|endoftext|>ΣσİßÉé日🎉1½\n\x85")), st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"])), max_size=60), max_size=4))
def test_against_the_library_on_any_text(texts):
    with open(PATH, encoding="utf-8") as file:
        shared = bpe._coder(file.read())
    check(shared, texts)


def test_table(spark, docs, doc_rows, clashing, empty):
    rows = bpe.encode_documents(clashing, PATH).collect()
    texts = sorted((str(r[0]), LIBRARY.encode(r[1] or "", add_special_tokens=False).ids) for r in doc_rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == texts
    digests = {(str(r["doc_id"]), r["ids_sha256"], r["n_tokens"]) for r in bpe.encode_documents(docs, PATH, digests=True).collect()}
    assert digests == {(d, hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), len(i)) for d, i in texts}
    assert bpe.encode_documents(empty, PATH).count() == 0


def test_decoding(spark, docs):
    coded = bpe.encode_documents(docs, PATH)
    assert bpe.decode_ids(coded, PATH, output="again").where("again <> decoded").count() == 0
    rows = spark.createDataFrame([(None,), ([],), ([10**6, 320],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode_ids(rows, PATH).collect()] == [None, "", LIBRARY.decode([320], skip_special_tokens=False)]
