"""The likelihood at given coefficients by DataFrame expressions: for few columns, and to check the kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def softmax(df: DataFrame, stratum: str, x: list[str], beta: list[float], offset: str | None = None) -> DataFrame:
    """df with eta, prob and log_sum (log of the set's sum of exp eta)."""
    w = W.partitionBy(stratum)
    eta = sum((F.lit(float(b)) * F.col(c) for c, b in zip(x, beta)), F.col(offset) if offset else F.lit(0.0))
    top = df.withColumn("eta", eta).withColumn("_m", F.max("eta").over(w)).withColumn("_e", F.exp(F.col("eta") - F.col("_m")))
    total = F.sum("_e").over(w)
    return top.withColumn("prob", F.col("_e") / total).withColumn("log_sum", F.col("_m") + F.log(total)).drop("_m", "_e")


def _by_set(soft: DataFrame, stratum: str, choice: str, x: list[str]) -> DataFrame:
    """Per set: probability means of x and of products, and the chosen row's x."""
    p, n = F.col("prob"), len(x)
    own = soft.groupBy(stratum).agg(
        *(F.sum(p * F.col(c)).alias(f"m{i}") for i, c in enumerate(x)),
        *(F.sum(p * F.col(x[i]) * F.col(x[j])).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)),
        *(F.sum(F.when(F.col(choice) == 1, F.col(c)).otherwise(F.lit(0.0))).alias(f"c{i}") for i, c in enumerate(x)),
        F.sum(F.when(F.col(choice) == 1, F.col("eta") - F.col("log_sum"))).alias("ll"),
    )
    return own.filter("ll is not null")


def loglik_at(soft: DataFrame, stratum: str, choice: str, x: list[str]) -> DataFrame:
    return _by_set(soft, stratum, choice, x).agg(F.sum("ll").alias("loglik"))


def gradient_at(soft: DataFrame, stratum: str, choice: str, x: list[str]) -> DataFrame:
    """(term, g)."""
    one = _by_set(soft, stratum, choice, x).agg(*(F.sum(F.col(f"c{i}") - F.col(f"m{i}")).alias(f"g{i}") for i in range(len(x))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("term"), F.col(f"g{i}").alias("g")) for i, c in enumerate(x)))).alias("r")).select("r.*")


def hessian_at(soft: DataFrame, stratum: str, choice: str, x: list[str]) -> DataFrame:
    """(i, j, h) for i <= j, numbered from 1."""
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    one = _by_set(soft, stratum, choice, x).agg(*(F.sum(F.col(f"m{i}") * F.col(f"m{j}") - F.col(f"m{i}_{j}")).alias(f"h{i}_{j}") for i, j in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"h{i}_{j}").alias("h")) for i, j in pairs))).alias("r")).select("r.*")


def gram_table(df: DataFrame, x: list[str]) -> DataFrame:
    """(i, j, v) of X'X for i <= j, numbered from 1."""
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    one = df.agg(*(F.sum(F.col(x[i]) * F.col(x[j])).alias(f"v{i}_{j}") for i, j in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"v{i}_{j}").alias("v")) for i, j in pairs))).alias("r")).select("r.*")
