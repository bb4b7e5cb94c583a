"""Result tables of fits."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def confint_rows(fit, level: float = 0.95, robust: bool = True) -> list[dict]:
    z = NormalDist().inv_cdf(0.5 + level / 2)
    low, high = (f"{100 * (1 - level) / 2:g} %", f"{100 * (1 + level) / 2:g} %")
    return [{"term": n, low: b - z * s, high: b + z * s} for n, b, s in zip(fit.names, fit.beta.tolist(), fit.se(robust).tolist())]


def tidy_rows(fit, robust: bool = True, level: float = 0.95, exponentiate: bool = False) -> list[dict]:
    """term, estimate, std_error, statistic, p_value, conf_low, conf_high; exponentiate touches estimate and interval only."""
    z, out = NormalDist().inv_cdf(0.5 + level / 2), []
    turn = math.exp if exponentiate else float
    for n, b, s in zip(fit.names, fit.beta.tolist(), fit.se(robust).tolist()):
        out.append({"term": n, "estimate": turn(b), "std_error": s, "statistic": b / s, "p_value": p_value(b / s), "conf_low": turn(b - z * s), "conf_high": turn(b + z * s)})
    return out


def summary_text(fit, level: float, robust: bool) -> str:
    kind = "clustered" if robust and fit.robust_vcov is not None else "model-based"
    lines = [f"Conditional logit: {fit.n_obs} rows, {fit.n_groups} choice sets" + (f", {fit.n_clusters} clusters" if fit.n_clusters else ""), f"Log likelihood {fit.loglik:.4f}; converged: {fit.converged} after {fit.iterations} iterations; {kind} standard errors", ""]
    lines.append(f"{'':24}{'estimate':>12}{'std.error':>12}{'z':>10}{'p':>11}{'low':>12}{'high':>12}")
    for r in tidy_rows(fit, robust, level):
        lines.append(f"{r['term'][:24]:24}{r['estimate']:12.6f}{r['std_error']:12.6f}{r['statistic']:10.3f}{r['p_value']:11.3g}{r['conf_low']:12.6f}{r['conf_high']:12.6f}")
    return "\n".join(lines)


def with_metadata(table: DataFrame, fit, **labels: str) -> DataFrame:
    """A tidy table with the model's counts, odds ratios and labels."""
    for k, v in labels.items():
        table = table.withColumn(k, F.lit(v))
    return table.withColumns(
        {
            "odds_ratio": F.exp("estimate"), "or_low": F.exp("conf_low"), "or_high": F.exp("conf_high"), "n_obs": F.lit(fit.n_obs), "n_events": F.lit(fit.n_events), "n_sets": F.lit(fit.n_groups),
            "loglik": F.lit(fit.loglik), "concordance": F.lit(None).cast("double"), "converged": F.lit(fit.converged), "dropped": F.lit(False), "reason": F.lit(None).cast("string"),
        }
    )


def append_dropped(table: DataFrame, dropped: DataFrame) -> DataFrame:
    """table and a row with nulls for each (term, reason) that was left out."""
    return table.unionByName(dropped.select("term", "reason", F.lit(True).alias("dropped")), allowMissingColumns=True)


def formatted(table: DataFrame) -> DataFrame:
    """Estimates and intervals as text with three decimals, and stars by p_value."""
    three = lambda c: F.format_number(F.col(c), 3)
    stars = F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").when(F.col("p_value") < 0.1, ".").otherwise("")
    return table.withColumns({"estimate_text": F.concat(three("estimate"), stars), "ci_text": F.concat(F.lit("["), three("conf_low"), F.lit(", "), three("conf_high"), F.lit("]")), "stars": stars})


def column_order(table: DataFrame, first: list[str]) -> DataFrame:
    return table.select(*[c for c in first if c in table.columns], *[c for c in table.columns if c not in first])
