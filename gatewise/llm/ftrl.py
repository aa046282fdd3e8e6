"""Follow-the-regularised-leader (proximal, elastic net) on hashed features, by
shards whose weights are averaged: shared by the language and quality models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class Ftrl:
    """Weights of ``size`` features times ``width`` outputs."""

    def __init__(self, size: int, width: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z, self.n = np.zeros((size, width)), np.zeros((size, width))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def update(self, at: np.ndarray, w: np.ndarray, grad: np.ndarray) -> None:
        """``w``: the weights that gave ``grad``, both rows of ``at``."""
        n = self.n[at]
        sigma = (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.alpha
        self.z[at] += grad - sigma * w
        self.n[at] = n + grad * grad


def shard_means(rows: DataFrame, train, shards: int, schema: str, keys: list[str]) -> DataFrame:
    """``train(pdf)`` gives rows of ``schema`` (keys and w) for each shard of the
    bounded sample ``rows`` (column shard); result: keys and the mean w, where
    weights that a shard doesn't name count as 0."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = train(pdf.sort_values("order", kind="stable"))
        common.release()
        return out

    out = rows.groupBy("shard").applyInPandas(run, schema)
    return out.groupBy(*keys).agg((F.sum("w") / shards).alias("w"))
