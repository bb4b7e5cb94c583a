"""Choice data with known coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTINUOUS = {"lnDist": -0.5, "n_years_same_cfar": 1.0, "n_years_same_peorg": 0.8, "n_years_same_uni": 0.6}
FACTOR = {"Edudiff3": {"BothHigh": 0.8, "BothLow": 0.4, "Missing": -0.3}, "AgeDiffcat": {"2": -0.2, "3": -0.5, "4": -0.8, "5": -1.2}}
SHARES, SIZES = (0.05, 0.10, 0.10, 0.60, 0.15), (20.0, 100.0, 50.0, 5000.0, 50000.0)
#: Cumulative probabilities of a Poisson variable with mean 0.3.
_POISSON = (0.7408182206817179, 0.9630636868862332, 0.9964005068169105, 0.9997341888099782, 0.9999842149594583, 0.9999992165284272)


def _uniform(seed: int, *key: Column) -> Column:
    """A uniform draw in (0, 1) that depends on seed and key only, so that a lost partition comes back the same."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _normal(seed: int, *key: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *key))) * F.cos(2 * F.pi() * _uniform(seed + 1, *key))


def simulate(
    spark: SparkSession, n_egos: int = 5000, n_alts: int = 100, *, beta_continuous: dict[str, float] | None = None, beta_factor: dict[str, dict[str, float]] | None = None, use_offset: bool = True,
    strata_props: tuple[float, ...] = SHARES, strata_popsizes: tuple[float, ...] = SIZES, cluster_ratio: float = 1.3, seed: int = 42,
) -> tuple[DataFrame, dict[str, float]]:
    """(choice, strata_id, cluster_id, columns, correction if use_offset, raw factors) and the true coefficients.

    Columns named *lnDist* are N(9, 2), *n_years* Poisson(0.3), others N(0, 1). Choices are drawn from the
    softmax by the largest utility plus Gumbel noise.
    """
    continuous, factors = CONTINUOUS if beta_continuous is None else beta_continuous, FACTOR if beta_factor is None else beta_factor
    ego, alt = F.col("strata_id"), F.col("alt_id")
    grid = spark.range(n_egos * n_alts).select((F.floor(F.col("id") / n_alts) + 1).cast("int").alias("strata_id"), (F.col("id") % n_alts + 1).cast("int").alias("alt_id"))
    columns: dict[str, Column] = {}
    at = seed * 1000
    for name in continuous:
        at += 2
        if "lnDist" in name:
            columns[name] = 9 + 2 * _normal(at, ego, alt)
        elif "n_years" in name:
            u = _uniform(at, ego, alt)
            columns[name] = sum(((u > q).cast("double") for q in _POISSON), F.lit(0.0))
        else:
            columns[name] = _normal(at, ego, alt)
    truth = dict(continuous)
    raw: dict[str, Column] = {}
    for name, levels in factors.items():
        at += 2
        raw[f"{name}_raw"] = (F.floor(_uniform(at, ego, alt) * (len(levels) + 1)) + 1).cast("int")
    df = grid.withColumns(columns | raw)
    dummies = {f"{f}_{v}": (F.col(f"{f}_raw") == k).cast("double") for f, levels in factors.items() for k, v in enumerate(levels, 2)}
    truth |= {f"{f}_{v}": b for f, levels in factors.items() for v, b in levels.items()}
    df = df.withColumns(dummies)
    if use_offset:
        u, edge, s = _uniform(at + 2, ego, alt), 0.0, F.lit(len(strata_props))
        for k, share in reversed(list(enumerate(strata_props[:-1], 1))):
            edge = sum(strata_props[:k])
            s = F.when(u < edge, F.lit(k)).otherwise(s)
        size = F.element_at(F.array(*(F.lit(float(x)) for x in strata_popsizes)), F.col("_s"))
        df = df.withColumn("_s", s.cast("int")).withColumn("correction", -F.log(F.count(F.lit(1)).over(W.partitionBy("strata_id", "_s")) / size)).drop("_s")
    eta = sum((F.lit(b) * F.col(n) for n, b in truth.items()), F.col("correction") if use_offset else F.lit(0.0))
    noisy = eta - F.log(-F.log(_uniform(at + 4, ego, alt)))
    best = F.row_number().over(W.partitionBy("strata_id").orderBy(F.desc("_u"), "alt_id")) == 1
    df = df.withColumn("_u", noisy).withColumn("choice", best.cast("int"))
    clusters = max(1, round(n_egos / cluster_ratio))
    df = df.withColumn("cluster_id", (F.floor(_uniform(at + 6, ego) * clusters) + 1).cast("int"))
    names = [*continuous, *dummies]
    return df.select("choice", "strata_id", "cluster_id", *names, *(["correction"] if use_offset else []), *raw), truth
