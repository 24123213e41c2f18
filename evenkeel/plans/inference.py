"""Attribute inference: a logistic regression on embeddings, fitted by reweighted sums and judged on held-out rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Gradient and second derivatives of the log-likelihood at ``weights``, summed in the tasks and then by Spark.

    What comes to the driver has the size of the model: d (d + 1) numbers for d weights.
    """
    d = len(weights)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * (d + 1))
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.ones(len(batch)), np.array(batch["x"].tolist(), float)])
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -34.5, 34.5)))
                total += np.concatenate([x.T @ (batch["y"].to_numpy(float) - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    out = np.zeros(d * (d + 1))
    for r in rows.select("x", "y").mapInPandas(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def fit_classifier(rows: DataFrame, ridge: float = 1.0, rounds: int = 20, tolerance: float = 1e-8) -> list[float]:
    """Weights, the constant first, of a logistic regression of ``y`` (0 or 1) on ``x`` (array); ``ridge`` bears on all but the constant.

    Newton's steps from zero until none is longer than ``tolerance``. Rows without x or y are left out; without
    rows all weights are 0 and there is one of them.
    """
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL")
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        return [0.0]
    weights, penalty = np.zeros(size + 1), ridge * np.diag([0.0] + [1.0] * size)
    for _ in range(rounds):
        sums = _sums(rows, weights)
        d = len(weights)
        step = np.linalg.lstsq(sums[d:].reshape(d, d) + penalty, sums[:d] - penalty @ weights, rcond=None)[0]
        weights = weights + step
        if np.abs(step).max() <= tolerance:
            break
    return weights.tolist()


def inferred(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Adds ``s``, the logit of the attribute, by built-in functions alone."""
    product = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(w)) for w in weights[1:]]), lambda x, w: x * w), F.lit(float(weights[0])), lambda t, x: t + x)
    return rows.withColumn("s", product)
