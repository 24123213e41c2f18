"""Toxicity by multiple-instance learning: document labels train scores of sentences.

A document is toxic if one of its sentences is. A sentence has the probability
``sigmoid(b + sum of the weights of its words)``; noisy-or combines a document's sentences to
``1 - product of (1 - p)``. The weights are fitted to document labels by gradient descent, and then
tell which sentences give offence. They begin at, and are drawn back to, what a word's documents say
of it alone: where several words explain a document, noisy-or would leave some of them unlearned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, text_of

MAX_LABELLED = 8000
THRESHOLD = 0.3
_WORD = regex.compile(r"\p{L}+")
_SENTENCE = regex.compile(r"[^.!?\n]+")


#: Words are features, and so are their first letters: inflected and compound forms share them.
STEMS = (4, 6)
CACHE_WORDS = 300_000
DOUBT = 5


def features_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}~" for n in STEMS if len(word) >= n]]


@dataclass
class SentenceModel:
    bias: float
    weights: dict[str, float]
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def hits(self, sentence: str) -> set[str]:
        """The features of a lower-cased sentence that have a weight."""
        found: set[str] = set()
        known = self.known
        for w in _WORD.findall(sentence):
            own = known.get(w)
            if own is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                own = known[w] = tuple(f for f in features_of(w) if f in self.weights)
            if own:
                found.update(own)
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of its offending sentences."""
        plain = math.log1p(-_sigmoid(self.bias))
        clean, bad, n = 0.0, [], 0
        for m in _SENTENCE.finditer(text or ""):
            n += 1
            hit = self.hits(m.group().lower())
            if not hit:
                clean += plain
                continue
            p = _sigmoid(self.bias + math.fsum(self.weights[f] for f in hit))
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= THRESHOLD:
                bad.append((m.start(), m.end(), p))
        return -math.expm1(clean if n else plain), bad


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(documents: list[tuple[int, list[list[int]], int]], words: list[str], prior: list[float] | None = None, rounds: int = 200, penalty: float = 1e-3) -> SentenceModel:
    """Fits the model to documents (number of sentences, word places of the sentences that have any, label).

    ``prior`` has the weights to which the penalty draws (none: zero).

    Without labels of both kinds all weights are zero and the bias gives the share of toxic
    documents. Sentences without a chosen word are alike and enter as their number.
    """
    n, toxic = len(documents), sum(y for _, _, y in documents)
    share = (toxic + 1) / (n + 2)
    if not toxic or toxic == n:
        return SentenceModel(math.log(share / (1 - share)), {})
    rows, cols, docs = [], [], []
    for doc, (_, hits, _) in enumerate(documents):
        for sentence in hits:
            rows += [len(docs)] * len(sentence)
            cols += sentence
            docs.append(doc)
    rows, cols, docs = np.array(rows, np.int64), np.array(cols, np.int64), np.array(docs, np.int64)
    y = np.array([d[2] for d in documents], float)
    plain = np.array([max(1, d[0]) - len(d[1]) if d[0] or not d[1] else 0 for d in documents], float)
    drawn = np.array(prior, float) if prior is not None else np.zeros(len(words))
    theta, bias = drawn.copy(), -math.log(max(2.0, sum(max(1, d[0]) for d in documents) / n) / share)
    step, square, square_b = 0.5, np.full(len(words), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, theta[cols], len(docs)), -30, 30)))
        p0 = _sigmoid(max(-30.0, min(30.0, bias)))
        none = np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-9)), n) + plain * math.log1p(-min(p0, 1 - 1e-9))  # log of no toxic sentence
        slope = np.where(y > 0, -np.exp(none) / np.maximum(-np.expm1(none), 1e-9), 1.0) / n
        own = slope[docs] * p
        grad = np.bincount(cols, own[rows], len(words)) + penalty * (theta - drawn)
        grad_b = own.sum() + (slope * plain).sum() * p0
        square += grad**2
        square_b += grad_b**2
        theta -= step * grad / np.sqrt(square)
        bias -= step * grad_b / math.sqrt(square_b)
    return SentenceModel(float(bias), {w: float(t) for w, t in zip(words, theta) if abs(t) > 0.02})


def _words_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([sorted({f for w in set(_WORD.findall(t.lower())) for f in features_of(w)}) for t in batch], dtype="object")


def _choose_words(sample: DataFrame, max_words: int, min_documents: int) -> list[tuple[str, float]]:
    """The words whose occurrence and the label go together most, by the chi-square of their document counts.

    Each comes with its weight of evidence: the logarithm of its odds among toxic documents over those
    of all, with ``DOUBT`` clean documents more than were seen, and no less than 0.
    """
    totals = sample.agg(F.count("*").alias("n"), F.sum("_label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not 0 < toxic < n:
        return []
    counts = sample.select("_label", F.explode(F.pandas_udf(_words_of, "array<string>")("_text")).alias("w")).groupBy("w").agg(F.count("*").cast("double").alias("d"), F.sum("_label").cast("double").alias("a")).where(F.col("d") >= min_documents)
    d, a = F.col("d"), F.col("a")
    b, c = d - a, F.lit(float(toxic)) - a
    strength = n * F.pow(a * (n - d - c) - b * c, F.lit(2.0)) / F.greatest(d * (n - d) * float(toxic) * float(n - toxic), F.lit(1.0))
    best = counts.withColumn("s", strength).where("s >= 6.6").orderBy(F.desc("s"), "w").limit(max_words)
    usual = math.log(toxic / (n - toxic))
    return [(r["w"], max(0.0, math.log((r["a"] + 0.1) / (r["d"] - r["a"] + DOUBT)) - usual)) for r in best.select("w", "a", "d").collect()]


def held_out(id_column: str = "doc_id"):
    """Rows kept from learning: those whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_labelled: int = MAX_LABELLED, max_words: int = 3000, min_documents: int = 4) -> SentenceModel:
    """Fits the model to at most ``max_labelled`` labelled documents that aren't held out, chosen by a hash of the id.

    Words are counted and chosen, and sentences turned to word places, by Spark; the driver gets
    the places of at most ``max_words`` words in the sentences of the sample. Of ids that come more
    than once, at most ``2 * max_labelled`` rows take part in all.
    """
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    chosen = usable.groupBy(F.col(id_column).alias("_label_id")).agg(F.max(label_column).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), "_label_id"), "_label_id").limit(max_labelled)
    found = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    ship(docs.sparkSession)
    sample = materialize(found.select("_id", "_text", F.col("_label").cast("int").alias("_label")), "toxicity-sample")
    chosen_words = _choose_words(sample, max_words, min_documents)
    words = [w for w, _ in chosen_words]
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place = sent.value
        for texts in batches:
            rows = []
            for text in texts:
                sentences = [place.keys() & {f for w in set(_WORD.findall(x.lower())) for f in features_of(w)} for x in _SENTENCE.findall(text)]
                rows.append((len(sentences), [sorted(place[w] for w in x) for x in sentences if x]))
            yield pd.DataFrame(rows, columns=["n", "hits"])

    rows = sample.select("_id", "_label", F.pandas_udf(places, "n int, hits array<array<int>>")("_text").alias("f")).orderBy("_id", "f").limit(2 * max_labelled).collect()
    return fit([(r["f"]["n"], r["f"]["hits"], r["_label"]) for r in rows], words, [x for _, x in chosen_words])


def score_documents(docs: DataFrame, model: SentenceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores whole texts: ``id_column, score double, offending array<struct<start, end, score>>``.

    Places are code points of the text, end exclusive. Null and empty texts are one empty sentence.
    Very long texts are scored whole, sentence by sentence.
    The model, a few thousand words at most, is broadcast. Repeated rows stay; other columns are
    neither read nor returned; empty tables give empty results.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            rows = [own.score(t) for t in texts]
            yield pd.DataFrame({"score": [r[0] for r in rows], "offending": [[{"start": a, "end": b, "score": p} for a, b, p in r[1]] for r in rows]})

    udf = F.pandas_udf(scored, "score double, offending array<struct<start:int,end:int,score:double>>")
    return docs.select(F.col(id_column), udf(text_of(text_column)).alias("_scored")).select(id_column, F.least(F.greatest("_scored.score", F.lit(0.0)), F.lit(1.0)).alias("score"), "_scored.offending")
