import random

import public_tokenizers as P
import pytest

from evenkeel.llm import token_counts as C


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken")) as file:
        return file.read()


def test_edits_equal_a_new_count(ranks):
    counter = C.PieceCounter(ranks, P.PATTERN)
    rng = random.Random(9)
    pieces = ["word", "  ", "\n", " \t ", "don't", "1234", "é", "!!", " x", "   end", "日本", "'s", "a" * 30]
    for _ in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 400)))
        doc = C.EditableDocument(counter, text)
        for _ in range(6):
            a = rng.randint(-2, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 3, 40, 500])
            new = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 4, 60])))
            doc.edit(a, b, new)
            low = min(max(a, 0), len(text))
            text = text[:low] + new + text[min(max(b, low), len(text)) :]
            assert doc.text == text
            assert doc.n_tokens == len(counter.coder.encode_ordinary(text))
            assert doc.tree.chars[1] == len(text)


def test_long_texts_are_encoded_again_in_part_only(ranks):
    counter = C.PieceCounter(ranks, P.PATTERN)
    doc = C.EditableDocument(counter, "some words go here and there. " * 5000)
    assert doc.edit(70_000, 70_004, "other") < 3000


def test_query_columns(spark, docs, doc_rows, clashing, empty, ranks):
    edits = spark.createDataFrame([(i, 1, 0, 3, "new ") for i in range(60)] + [(3, 0, 5, 5, None), (None, 1, 0, 1, "x"), (9999, 1, 0, 1, "x")], "doc_id long, seq int, start int, end int, text string")
    out = C.count_with_edits(C.join_edits(clashing, edits), ranks, P.PATTERN).collect()
    counter = C.PieceCounter(ranks, P.PATTERN)
    texts = {r[0]: r[1] or "" for r in doc_rows}
    assert len(out) == len(doc_rows)
    for r in out:
        assert r["n_tokens"] == len(counter.coder.encode_ordinary(texts[r["doc_id"]]))
        want = "new " + texts[r["doc_id"]][3:] if r["n_edits"] else texts[r["doc_id"]]
        assert r["edited_text"] == want and r["n_tokens_edited"] == len(counter.coder.encode_ordinary(want))
    assert C.count_with_edits(C.join_edits(empty, edits), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_edit_table_against_a_new_count(spark, clashing, doc_rows, empty, ranks, monkeypatch, most):
    """One document in eight is edited; the others come from their kept trees."""
    monkeypatch.setattr(C, "MOST_EDITED", most)
    edits = spark.createDataFrame([(i, s, 3 * s, 3 * s + 2, "put in ") for i in range(0, 60, 8) for s in (1, 2)] + [(205, 1, 500, 503, None), (None, 1, 0, 1, "x"), (9999, 1, 0, 1, "x")], "doc_id long, seq int, start int, end int, text string")
    counter = C.PieceCounter(ranks, P.PATTERN)
    count = lambda t: len(counter.coder.encode_ordinary(t))
    texts = {r[0]: r[1] or "" for r in doc_rows}
    out = C.count_with_edit_table(clashing, edits, ranks, P.PATTERN).collect()
    assert len(out) == len(doc_rows)
    for r in out:
        want = texts[r["doc_id"]]
        if r["doc_id"] == 205:
            want = want[:500] + want[503:]
        elif r["doc_id"] in range(0, 60, 8):
            for s in (1, 2):
                want = want[: 3 * s] + "put in " + want[3 * s + 2 :]
        assert r["edited_text"] == want and r["n_tokens"] == count(texts[r["doc_id"]]) and r["n_tokens_edited"] == count(want)
        assert r["n_edits"] or r["chars_encoded_again"] == 0
    assert C.count_with_edit_table(empty, edits, ranks, P.PATTERN).count() == 0


def test_kept_trees_are_edited_without_encoding_the_rest(spark, docs, clashing, doc_rows, ranks, tmp_path):
    """Trees go through a table; a second batch of edits encodes what it touches and no more."""
    counter = C.PieceCounter(ranks, P.PATTERN)
    built = C.build_trees(clashing, ranks, P.PATTERN)
    built.write.parquet(f"{tmp_path}/trees")
    kept = spark.read.parquet(f"{tmp_path}/trees")
    assert set(clashing.columns) <= set(kept.columns)
    texts = {r[0]: r[1] or "" for r in doc_rows}
    assert {(r["doc_id"], r["n_tokens"]) for r in kept.collect()} == {(d, len(counter.coder.encode_ordinary(t))) for d, t in texts.items()}
    edits = spark.createDataFrame([(205, 1, 500, 503, "new"), (3, 1, 0, 2, ""), (203, 1, 9, 9, " more")], "doc_id long, seq int, start int, end int, text string")
    once = C.apply_edits(C.join_edits(kept, edits), ranks, P.PATTERN)
    once.write.parquet(f"{tmp_path}/once")
    twice = C.apply_edits(C.join_edits(spark.read.parquet(f"{tmp_path}/once"), edits), ranks, P.PATTERN).collect()
    for r in twice:
        want = texts[r["doc_id"]]
        for _ in range(2):
            want = {205: want[:500] + "new" + want[503:], 3: want[2:], 203: want + " more"}.get(r["doc_id"], want)
        assert (r["text"] or "") == want and r["n_tokens"] == len(counter.coder.encode_ordinary(want))
        assert sum(x["chars"] for x in r["tree"]) == len(want)
        assert r["n_edits"] == (r["doc_id"] in (205, 3, 203)) and r["chars_encoded_again"] < 3000
        assert r["n_edits"] or r["chars_encoded_again"] == 0
    assert {r["size"] for r in twice} == {"x"}
