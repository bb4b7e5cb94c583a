"""Fits of conditional (McFadden) logit models: `fit_formula` and `fit_matrix`."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .functions.tables import confint_rows, summary_text, tidy_rows
from .operators import design as D
from .operators import kernel, newton, sandwich
from .operators.pack import pack, rows_of
from .operators.validate import SETS_MESSAGE, dependent_columns
from .plans.formula import parse

#: Bytes of design columns that one Arrow batch may hold.
BATCH_BYTES = 32 << 20


@dataclass
class ClogitFit:
    names: list[str]
    beta: np.ndarray
    model_vcov: np.ndarray
    robust_vcov: np.ndarray | None
    loglik: float
    gradient: np.ndarray
    information: np.ndarray
    iterations: int
    converged: bool
    n_obs: int
    n_groups: int
    n_clusters: int | None
    #: formula term of each column
    terms: list[str]
    #: (term, reason) of the columns that were left out
    dropped_terms: list[tuple[str, str]] = field(default_factory=list)
    n_dropped_rows: int = 0
    formula: str | None = None
    n_events: int | None = None

    @property
    def coef(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist()))

    @property
    def hessian(self) -> np.ndarray:
        return -self.information

    def vcov(self, robust: bool = True) -> np.ndarray:
        return self.robust_vcov if robust and self.robust_vcov is not None else self.model_vcov

    def se(self, robust: bool = True) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov(robust)))

    def loglik_row(self) -> dict:
        return {"loglik": self.loglik, "df": len(self.names), "nobs": self.n_obs}

    def confint(self, names: list[str] | None = None, level: float = 0.95, robust: bool = True) -> list[dict]:
        return [r for r in confint_rows(self, level, robust) if names is None or r["term"] in names]

    def tidy(self, spark: SparkSession, *, robust: bool = True, level: float = 0.95, exponentiate: bool = False) -> DataFrame:
        kinds = "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double"
        return spark.createDataFrame([tuple(r.values()) for r in tidy_rows(self, robust, level, exponentiate)], kinds)

    def dropped(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.dropped_terms, "term string, reason string")

    def summary(self, level: float = 0.95, robust: bool = True) -> str:
        return summary_text(self, level, robust)

    def __repr__(self) -> str:
        coef = ", ".join(f"{n}={b:.6f}" for n, b in self.coef.items())
        return f"ClogitFit({self.n_obs} rows, {self.n_groups} sets, loglik {self.loglik:.4f}, converged {self.converged}: {coef})"

    def to_json(self) -> str:
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return json.dumps(plain)

    @classmethod
    def from_json(cls, text: str) -> ClogitFit:
        own = json.loads(text)
        for k in ("beta", "model_vcov", "robust_vcov", "gradient", "information"):
            own[k] = None if own[k] is None else np.array(own[k])
        own["dropped_terms"] = [tuple(x) for x in own["dropped_terms"]]
        return cls(**own)


def _counts(df: DataFrame, needed: list[str], choice: str, extra: list) -> tuple[int, int, int, list]:
    """Rows, complete rows, complete rows whose choice isn't 0 or 1, and extra aggregates over complete rows; one pass."""
    ok = ~D.incomplete(df, needed)
    y = F.col(f"`{choice}`").cast("double")
    row = df.agg(F.count(F.lit(1)), F.count_if(ok), F.count_if(ok & ~y.isin(0.0, 1.0)), *extra).first()
    if not row[1]:
        raise ValueError("no complete cases")
    if row[2]:
        raise ValueError(f"{choice} must be 0 or 1 in every row; {row[2]} rows differ")
    return row[0], row[1], row[2], list(row[3:])


def fit_columns(
    df: DataFrame, names: list[str], columns: list, terms: list[str], *, choice: str, stratum: str, cluster: str | None = None, offset: str | None = None, order_by: list[str] | None = None,
    drop_collinear: bool = True, scale: bool = False, max_iter: int = 25, tol: float = 1e-6, compat: bool = False, n_rows: int | None = None,
) -> ClogitFit:
    """The fit over design columns (expressions on df, whose rows are complete and whose choices are 0 or 1). n_rows: rows of df, if they have been counted."""
    p = len(names)
    spark = df.sparkSession
    rows = rows_of(df, stratum=stratum, y=F.col(f"`{choice}`"), x=columns, offset=F.col(f"`{offset}`") if offset else None, cluster=cluster, order_by=order_by or [])
    packed = pack(rows, p, n_rows).persist(StorageLevel.MEMORY_AND_DISK)
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept_conf = conf.get(key)
    try:
        events, rows_a_block = packed.agg(F.sum(F.aggregate("n_chosen", F.lit(0).cast("long"), lambda s, v: s + v)), F.max(F.size("off"))).first()
        # packed by now; from here on a row is a block
        conf.set(key, str(int(min(10_000, max(1, BATCH_BYTES / (8 * p * (rows_a_block or 1)))))))
        about = kernel.describe(packed, p)
        if about["n_zero"] or about["n_multi"]:
            warnings.warn(SETS_MESSAGE.format(**about), stacklevel=3)
        if not order_by and (about["n_multi"] or cluster and about["n_mixed_clusters"]):
            raise ValueError("sets with several chosen rows or clusters need order_by: which one is first would be left to chance")
        dropped = dependent_columns(names, about, drop_collinear)
        keep = np.array([i for i, n in enumerate(names) if n not in dict(dropped)], int)
        if not len(keep):
            raise ValueError("no design columns are left")
        by = np.where(~about["binary"] & (np.sqrt(about["variance"]) > 1), np.sqrt(about["variance"]), 1.0)[keep] if scale else np.ones(len(keep))
        columns_kept = kernel.Columns(keep, by if (by != 1).any() else None)
        best = newton.maximise(packed, p, columns_kept, max_iter=max_iter, tol=tol, compat=compat)
        kept_names = [names[i] for i in keep]
        vcov = newton.invert(best.information, kept_names)
        robust, n_clusters = (None, None) if cluster is None else sandwich.robust(packed, p, best.beta, columns_kept, vcov, about["n_groups"])
    finally:
        conf.set(key, kept_conf)
        packed.unpersist()
    outer = np.outer(by, by)
    return ClogitFit(
        kept_names, best.beta / by, vcov / outer, None if robust is None else robust / outer, best.loglik, best.gradient * by, best.information * outer, best.iterations, best.converged,
        about["n_obs"], about["n_groups"], n_clusters, [terms[i] for i in keep], dropped, n_events=int(events),
    )


def fit_formula(
    df: DataFrame, formula: str, *, stratum: str, cluster: str | None = None, offset: str | None = None, levels: dict[str, list[str]] | None = None, order_by: list[str] | None = None,
    drop_collinear: bool = True, scale: bool = False, max_iter: int = 25, tol: float = 1e-6, compat: bool = False,
) -> ClogitFit:
    """Fit `choice ~ terms` over the complete cases of df.

    levels: {column: [reference, ...]} for factors; string columns without an entry take their sorted distinct values.
    order_by: columns that order the rows of a set; needed where a set has several chosen rows or clusters.
    compat: let sets without a chosen row count in the final Hessian.
    """
    f = parse(formula)
    needed = [c for c in (f.response, *f.columns, stratum, cluster, offset) if c]
    D.check_columns(df, [*needed, *(order_by or [])])
    slim = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*needed, *(order_by or [])])])
    cases = D.complete_cases(slim, needed)
    n_all, n_kept, _, _ = _counts(slim, needed, f.response, [])
    own = D.build(cases, f, levels)
    fit = fit_columns(cases, own.names, own.columns, own.terms, choice=f.response, stratum=stratum, cluster=cluster, offset=offset, order_by=order_by, drop_collinear=drop_collinear, scale=scale, max_iter=max_iter, tol=tol, compat=compat, n_rows=n_kept)
    fit.formula, fit.n_dropped_rows = formula, n_all - n_kept
    return fit


def fit_matrix(df: DataFrame, x_cols: list[str], *, choice: str, stratum: str, offset: str | None = None, cluster: str | None = None, order_by: list[str] | None = None, max_iter: int = 25, tol: float = 1e-6, compat: bool = False) -> ClogitFit:
    """Fit numeric columns as they are. Columns without variance only give a warning; missing values are an error."""
    D.check_columns(df, [*x_cols, choice, stratum, *(c for c in (offset, cluster) if c)])
    for c in x_cols:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"{c} is not numeric")
    needed = [*x_cols, choice, stratum, *(c for c in (offset, cluster) if c)]
    columns = [F.col(f"`{c}`").cast("double") for c in x_cols]
    n_all, n_kept, _, variances = _counts(df, needed, choice, [F.coalesce(F.var_samp(c), F.lit(0.0)) for c in columns])
    if n_all != n_kept:
        raise ValueError("missing values in the design, choice, stratum, offset or cluster columns")
    flat = [c for c, v in zip(x_cols, variances) if v < np.finfo(float).eps]
    if flat:
        warnings.warn(f"columns without variance: {', '.join(flat)}", stacklevel=2)
    return fit_columns(df, x_cols, columns, list(x_cols), choice=choice, stratum=stratum, cluster=cluster, offset=offset, order_by=order_by, drop_collinear=False, max_iter=max_iter, tol=tol, compat=compat, n_rows=n_kept)
