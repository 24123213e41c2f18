"""Negative sampling and its invariants. Choices are hashes, the same in every run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import kept, numbered

MODULUS = 2147483647


def drawn(draw, seed: int) -> Column:
    """A number that looks random, from user, item and draw: a step of a multiplicative congruential generator."""
    mixed = (F.col("user_id") * 7919 + F.col("item_id") * 104729 + draw * 1299709 + F.lit(seed).cast("long")) % MODULUS
    return F.pmod(mixed * 48271 % MODULUS, F.lit(MODULUS))


def item_numbers(items: DataFrame) -> DataFrame:
    """Items numbered from 0, for choice by number."""
    return numbered(items.select("item_id").distinct(), ["item_id"], "number")


def negatives(positives: DataFrame, items: DataFrame, known: DataFrame, per_positive: int, tries: int = 2, seed: int = 0) -> DataFrame:
    """Items that a user has not met: (user_id, item_id, negative_id).

    Each positive gets ``per_positive`` different ones, or all that the user has not met if these are
    fewer. It draws ``tries * per_positive`` numbers by hash; what the user knows and repeated draws go.
    Positives still short then get items by rank among those the user has not met. Known items are
    numbered and come together by user, so draws are not shuffled, only what is chosen, for its item.
    The work is in proportion to the positives and known pairs, not to users x items.
    """
    numbered = kept(item_numbers(items))
    total = numbered.agg(F.count("*").alias("n_items"))
    met = known.select("user_id", "item_id").join(numbered, "item_id").groupBy("user_id").agg(F.sort_array(F.collect_set("number")).alias("met"))
    own = positives.select("user_id", "item_id").groupBy("user_id").agg(F.collect_set("item_id").alias("own"))
    rows = own.join(met, "user_id", "left").join(F.broadcast(total), F.lit(True))
    chosen = _chooser(per_positive, tries, seed)("user_id", "own", F.coalesce("met", F.array().cast("array<bigint>")), "n_items")
    picked = rows.select("user_id", F.inline(chosen).alias("item_id", "number"))
    return picked.join(numbered.withColumnRenamed("item_id", "negative_id"), "number").select("user_id", "item_id", "negative_id")


def _chooser(per_positive: int, tries: int, seed: int):
    """A function of a user, its positives, the sorted numbers of what it knows and the number of items: an array of (positive, number)."""

    def ordinals(user: int, own: np.ndarray, draws: np.ndarray) -> np.ndarray:
        mixed = (np.int64(user) * 7919 + own[:, None] * 104729 + draws[None, :] * 1299709 + seed) % MODULUS
        return mixed * 48271 % MODULUS

    def of_user(user: int, own: np.ndarray, met: np.ndarray, n_items: int) -> list[tuple[int, int]]:
        drawn = ordinals(user, own, np.arange(1, tries * per_positive + 1)) % n_items
        at = np.minimum(np.searchsorted(met, drawn), max(len(met) - 1, 0))
        fresh = met[at] != drawn if len(met) else np.ones(drawn.shape, bool)
        free = n_items - len(met)
        # The j-th known number has number - j unknown ones below it: a rank moves past those with no more than itself.
        gaps, start = met - np.arange(len(met)), ordinals(user, own, np.array([0]))[:, 0]
        out = []
        for item, first, numbers, good in zip(own.tolist(), start.tolist(), drawn.tolist(), fresh.tolist()):
            found = list(dict.fromkeys(x for x, ok in zip(numbers, good) if ok))
            if len(found) < per_positive and free > 0:
                ranks = (first % free + np.arange(1, min(free, per_positive) + 1)) % free
                found = list(dict.fromkeys(found + (ranks + np.searchsorted(gaps, ranks, side="right")).tolist()))
            out.extend((item, x) for x in found[:per_positive])
        return out

    def choose(users: pd.Series, own: pd.Series, met: pd.Series, n_items: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "number": x} for i, x in of_user(u, np.asarray(o, np.int64), np.asarray(m, np.int64), n)] for u, o, m, n in zip(users, own, met, n_items)])

    return F.pandas_udf(choose, "array<struct<item_id:bigint,number:bigint>>")


def triplets(train: DataFrame, items: DataFrame, per_positive: int, seed: int = 0) -> DataFrame:
    """(user, positive, negative) rows of the train pairs."""
    return negatives(train, items, train, per_positive, seed=seed).select("user_id", F.col("item_id").alias("positive_id"), "negative_id")


def binary_samples(train: DataFrame, items: DataFrame, per_positive: int, seed: int = 0) -> DataFrame:
    """(user, item, label): each positive once with label 1 and its negatives with label 0."""
    drawn = negatives(train, items, train, per_positive, seed=seed).select("user_id", F.col("negative_id").alias("item_id"), F.lit(0).alias("label"))
    return train.select("user_id", "item_id", F.lit(1).alias("label")).union(drawn)


def violations(samples: DataFrame, train: DataFrame, positive: str, negative: str) -> DataFrame:
    """Counts that must be 0: positives that aren't observed, negatives that are."""
    bad_positive = samples.join(train.select("user_id", F.col("item_id").alias(positive)), ["user_id", positive], "left_anti").agg(F.count("*").alias("unobserved_positives"))
    bad_negative = samples.join(train.select("user_id", F.col("item_id").alias(negative)), ["user_id", negative], "left_semi").agg(F.count("*").alias("observed_negatives"))
    return bad_positive.join(bad_negative, F.lit(True))
