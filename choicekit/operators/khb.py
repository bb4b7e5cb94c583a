"""KHB decomposition: total, direct and indirect effects of key columns through mediators."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.levels import distinct_levels, is_categorical, safe_name
from ..functions.tables import p_value
from ..plans.formula import Formula
from . import design as D
from . import kernel
from .validate import require_one_chosen


@dataclass
class KhbResult:
    success: bool
    decomposition: list[dict] = field(default_factory=list)
    z_effects: list[dict] = field(default_factory=list)
    reduced: object = None
    full: object = None
    r_squared: dict[str, float] = field(default_factory=dict)
    error: str | None = None

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        one = "term string, total double, total_se double, direct double, direct_se double, indirect double, indirect_se double, z double, p_value double, conf_ratio double, conf_pct double"
        two = "term string, estimate double, std_error double, z double, p_value double"
        return spark.createDataFrame([tuple(r.values()) for r in self.decomposition], one), spark.createDataFrame([tuple(r.values()) for r in self.z_effects], two)


def demean(df: DataFrame, stratum: str, columns: list[tuple[str, Column]]) -> DataFrame:
    """df with a column for each (name, expression): the expression less its mean within the set."""
    w = W.partitionBy(stratum)
    return df.withColumns({n: c - F.avg(c).over(w) for n, c in columns})


def residual_coefficients(dm: DataFrame, x: list[str], z: list[str]) -> tuple[np.ndarray, dict[str, float]]:
    """Least-squares coefficients (x by z) of demeaned z on demeaned x, aliased ones 0, and the R squared of each z."""
    g = kernel.gram(dm, [*x, *z])
    p = len(x)
    xx, xz, zz = g[:p, :p], g[:p, p:], np.diag(g)[p:]
    coef = np.zeros((p, len(z)))
    size = np.sqrt(np.diag(xx))
    keep: list[int] = []
    for j in range(p):  # in order: columns that those before them explain are aliased
        if size[j] == 0:
            continue
        rest = xx[j, j] - (xx[j, keep] @ np.linalg.solve(xx[np.ix_(keep, keep)], xx[keep, j]) if keep else 0.0)
        if rest > 1e-10 * xx[j, j]:
            keep.append(j)
    if keep:
        coef[keep] = np.linalg.solve(xx[np.ix_(keep, keep)], xz[keep])
    explained = (coef * xz).sum(axis=0)
    return coef, {n: (float(e / t) if t > 0 else math.nan) for n, e, t in zip(z, explained, zz)}


def khb(
    df: DataFrame, *, key_vars: list[str], z_vars: list[str], controls: list[str] | None = None, stratum: str, cluster: str | None = None, choice: str = "choice", offset: str | None = None,
    levels: dict[str, list[str]] | None = None, order_by: list[str] | None = None, max_iter: int = 100, tol: float = 1e-6, verbose: bool = False,
) -> KhbResult:
    """Decompose the effects of key_vars through z_vars.

    Mediators are demeaned within sets and regressed on the demeaned keys and controls; the reduced model has the residuals in
    place of the mediators, so both models have the same likelihood. Terms are column names; controls and
    keys may be interactions `a:b`; the rows of a term are those of its own columns, never of another term
    whose name begins alike. Only complete cases are used. order_by: columns that order the rows of a set; needed where a
    set has several clusters, of which its first row's counts. verbose: print what is being done.
    """
    from ..fit import fit_columns

    controls = controls or []
    if any(":" in z for z in z_vars):
        raise ValueError("mediators can't be interactions")
    plain = [c for t in [*key_vars, *controls] for c in t.split(":")]
    D.check_columns(df, [*plain, *z_vars, choice, stratum, *(c for c in (cluster, offset) if c), *(order_by or [])])
    say = print if verbose else (lambda *_: None)
    needed = list(dict.fromkeys([*plain, *z_vars, choice, stratum, *(c for c in (cluster, offset) if c)]))
    cases = D.complete_cases(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*needed, *(order_by or [])])]), needed)
    require_one_chosen(cases, stratum, choice)

    terms = [tuple(t.split(":")) for t in [*key_vars, *controls]]
    xc = D.build(cases, Formula(choice, tuple(t[0] for t in terms if len(t) == 1), tuple(t for t in terms if len(t) > 1)), levels)
    z_levels = dict(levels or {})
    factors = [z for z in z_vars if z in z_levels or is_categorical(cases, z)]
    z_levels |= distinct_levels(cases, [z for z in factors if z not in z_levels])
    z_all = [(z, n, c) for z in z_vars for n, c in ([(f"{z}{v}", (F.col(f"`{z}`") == F.lit(v)).cast("double")) for v in z_levels[z]] if z in factors else [(z, F.col(f"`{z}`").cast("double"))])]

    x_names, z_names = [f"_x{i}" for i in range(len(xc.names))], [f"_z{i}" for i in range(len(z_all))]
    dm = demean(cases, stratum, [*zip(x_names, xc.columns), *((n, c) for n, (_, _, c) in zip(z_names, z_all))])
    coef, r2 = residual_coefficients(dm, x_names, z_names)
    resid = []
    for j, z in enumerate(z_names):
        e = F.col(z)
        for i, x in enumerate(x_names):
            if coef[i, j]:
                e = e - F.lit(float(coef[i, j])) * F.col(x)
        resid.append(e)
    common = {"choice": choice, "stratum": stratum, "cluster": cluster, "offset": offset, "order_by": order_by, "max_iter": max_iter, "tol": tol, "n_rows": cases.count()}
    z_display = [n for _, n, _ in z_all]
    try:
        n_key = len(xc.names)
        say(f"reduced model: {n_key} columns and {len(resid)} residuals")
        reduced = fit_columns(dm, [*xc.names, *(f"{safe_name(n)}_resid" for n in z_display)], [*xc.columns, *resid], [*xc.terms, *z_display], **common)
        # of a factor mediator the full model takes all levels but the first
        full_z = [(n, c, z) for z in z_vars for k, (own, n, c) in enumerate(t for t in z_all if t[0] == z) if not (z in factors and k == 0)]
        say(f"full model: {n_key + len(full_z)} columns")
        full = fit_columns(cases, [*xc.names, *(n for n, _, _ in full_z)], [*xc.columns, *(c for _, c, _ in full_z)], [*xc.terms, *(z for _, _, z in full_z)], **common)
    except (ValueError, np.linalg.LinAlgError) as error:
        return KhbResult(False, error=str(error))

    def row(fit, name):
        i = fit.names.index(name)
        return float(fit.beta[i]), float(fit.se()[i])

    parts = []
    keys = {":".join(t) for t in (tuple(k.split(":")) for k in key_vars)}
    for name, term in zip(xc.names[:n_key], xc.terms):
        if term not in keys or name not in reduced.names or name not in full.names:
            continue
        (t, ts), (d, ds) = row(reduced, name), row(full, name)
        indirect, se = t - d, math.sqrt(ts**2 + ds**2)
        parts.append({"term": name, "total": t, "total_se": ts, "direct": d, "direct_se": ds, "indirect": indirect, "indirect_se": se, "z": indirect / se, "p_value": p_value(indirect / se), "conf_ratio": t / d if abs(d) > 1e-10 else None, "conf_pct": 100 * (t - d) / t if abs(t) > 1e-10 else None})
    effects = []
    for n, _, _ in full_z:
        if n in full.names:
            b, s = row(full, n)
            effects.append({"term": n, "estimate": b, "std_error": s, "z": b / s, "p_value": p_value(b / s)})
    return KhbResult(True, parts, effects, reduced, full, dict(zip(z_display, r2.values())))
