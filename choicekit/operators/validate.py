"""Checks of choice sets and of design columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETS_MESSAGE = "{n_zero} choice sets have no chosen row (they don't count), {n_multi} have several (the first counts)"


def chosen_counts(df: DataFrame, stratum: str, choice: str) -> DataFrame:
    """stratum and the number of chosen rows of each set."""
    return df.groupBy(stratum).agg(F.sum(F.col(choice).cast("long")).alias("n_chosen"))


def set_problems(df: DataFrame, stratum: str, choice: str) -> DataFrame:
    """One row: n_sets, n_zero, n_multi; always exact."""
    counts = chosen_counts(df, stratum, choice)
    return counts.agg(F.count(F.lit(1)).alias("n_sets"), F.count_if(F.col("n_chosen") == 0).alias("n_zero"), F.count_if(F.col("n_chosen") > 1).alias("n_multi"))


def require_one_chosen(df: DataFrame, stratum: str, choice: str) -> None:
    row = set_problems(df, stratum, choice).first()
    if row.n_zero or row.n_multi:
        raise ValueError(f"every stratum must have exactly one chosen row; {row.n_zero} have none and {row.n_multi} several")


def column_variances(df: DataFrame, names: list[str], columns: list[Column]) -> DataFrame:
    """(name, variance) of all columns in one aggregate."""
    one = df.agg(*(F.var_samp(c).alias(f"v{k}") for k, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"v{k}").alias("variance")) for k, n in enumerate(names)))).alias("r")).select("r.name", "r.variance")


def dependent_columns(names: list[str], about: dict, drop_collinear: bool = True) -> list[tuple[str, str]]:
    """(name, reason) of the columns to leave out, from kernel.describe(): no variance, no variation within sets, or a residual below 1e-7 of the column given those before it."""
    out: dict[str, str] = {}
    for i, n in enumerate(names):
        if not about["variance"][i] >= np.finfo(float).eps:
            out[n] = "zero variance"
        elif about["spread"][i] == 0:
            out[n] = "no within-set variation"
    if drop_collinear and len(names) > 1:
        for r in (about["r"], about["r_within"]):
            left = [i for i, n in enumerate(names) if n not in out]
            basis = np.linalg.qr(r[:, left], mode="r") if left else np.zeros((0, 0))
            size = np.linalg.norm(r[:, left], axis=0)
            # the diagonal is what each column adds to those before it
            keep: list[int] = []
            for k, i in enumerate(left):
                v = basis[:, k].copy()
                if keep:
                    q = np.linalg.qr(basis[:, keep])[0]
                    for _ in range(2):
                        v -= q @ (q.T @ v)
                if np.linalg.norm(v) < 1e-7 * max(size[k], 1e-300):
                    out[names[i]] = "collinear"
                else:
                    keep.append(k)
    return [(n, out[n]) for n in names if n in out]
