import os
import random
import re

import numpy as np
import pytest

from evenkeel.llm import toxicity as X


def test_learns_sentences_from_document_labels(spark):
    rng = random.Random(1)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            sentences[rng.randrange(6)] += " " + rng.choice(["scoundrel", "blackguard", "wretch"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = X.score_documents(docs, model).join(spark.createDataFrame(labels, "doc_id long, q int, toxic int"), "doc_id").where(X.held_out()).collect()
    assert len(got) > 80
    assert all((r["score"] >= 0.3) == bool(r["toxic"]) for r in got)
    texts = dict(rows)
    for r in got:
        if r["toxic"]:
            assert any(w in texts[r["doc_id"]][s["start"] : s["end"]] for s in r["offending"] for w in ("scoundrel", "blackguard", "wretch"))


def test_edges(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = X.train(clashing, rows)
        out = X.score_documents(clashing, model)
        assert out.count() == docs.count()
        assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert X.score_documents(empty, model).count() == 0


def test_held_out_is_the_crc_of_the_id(spark):
    import zlib

    got = spark.range(200).select("id", X.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def features(word):
    return {word} | {word[:n] + "~" for n in (4, 6) if len(word) >= n}


def noisy_or(model, text):
    """The score of a text from the model's weights, sentence by sentence in NumPy."""
    sentences = [s for s in re.split(r"[.!?\n]+", text or "") if s] or [""]
    words = [{f for w in re.findall(r"[^\W\d_]+", s.lower()) for f in features(w)} for s in sentences]
    z = np.array([model.bias + sum(model.weights.get(f, 0.0) for f in ws) for ws in words])
    return 1 - np.prod(1 - 1 / (1 + np.exp(-z)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_documents_and_scores_from_the_weights(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels)
    got = X.score_documents(docs, model).join(labels, "doc_id").where(X.held_out()).join(docs, "doc_id").select("text", "score", "toxic").collect()
    caught = [r["score"] >= X.THRESHOLD for r in got if r["toxic"] == 1]
    clean = [r["score"] < X.THRESHOLD for r in got if r["toxic"] == 0]
    assert len(caught) > 100 and sum(caught) >= 0.9 * len(caught) and sum(clean) >= 0.97 * len(clean)
    letters = [r for r in got if all(c.isalpha() == bool(re.match(r"[^\W\d_]", c)) for c in r["text"])][:300]
    assert len(letters) == 300 and all(abs(r["score"] - noisy_or(model, r["text"])) < 1e-9 for r in letters)
