"""Cluster-robust variance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import kernel


def robust(packed: DataFrame, p: int, beta: np.ndarray, keep: kernel.Columns, vcov: np.ndarray, n_groups: int) -> tuple[np.ndarray, int]:
    """(sandwich variance, number of clusters): C/(C-1) * (G-1)/G * V (sum of u u') V."""
    names = [f"u{i}" for i in range(len(beta))]
    scores = kernel.cluster_scores(packed, p, beta, keep).persist()
    try:
        n = scores.count()
        if n < 2:
            raise ValueError("clustered standard errors need two clusters or more")
        meat = kernel.gram(scores, names)
    finally:
        scores.unpersist()
    return n / (n - 1) * (n_groups - 1) / n_groups * vcov @ meat @ vcov, n
