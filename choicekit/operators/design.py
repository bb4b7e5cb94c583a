"""Design columns from formula terms: numeric terms, treatment dummies and two-way interactions."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import distinct_levels, is_categorical, missing
from ..plans.formula import Formula


@dataclass(frozen=True)
class Design:
    names: list[str]
    columns: list[Column]
    #: formula term of each column
    terms: list[str]
    levels: dict[str, list[str]]


def check_columns(df: DataFrame, names: list[str]) -> None:
    lacking = [n for n in dict.fromkeys(names) if n not in df.columns]
    if lacking:
        raise ValueError(f"Column(s) not found in data: {', '.join(lacking)}")


def incomplete(df: DataFrame, names: list[str]) -> Column:
    """Whether a row misses a value in names."""
    bad = F.lit(False)
    for n in dict.fromkeys(names):
        bad = bad | missing(df, n)
    return bad


def complete_cases(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (not whole sets) without a missing value in names."""
    return df.filter(~incomplete(df, names))


def _factor(name: str, levels: list[str]) -> list[tuple[str, Column]]:
    """Dummies of all levels but the first."""
    return [(f"{name}{v}", (F.col(f"`{name}`") == F.lit(v)).cast("double")) for v in levels[1:]]


def build(df: DataFrame, formula: Formula, levels: dict[str, list[str]] | None = None) -> Design:
    """Columns of a formula over df (its complete cases). String columns are factors; levels given here are taken as declared."""
    levels = dict(levels or {})
    factors = [c for c in formula.columns if c in levels or is_categorical(df, c)]
    levels |= distinct_levels(df, [c for c in factors if c not in levels])

    def parts(name: str) -> list[tuple[str, Column]]:
        if name in factors:
            return _factor(name, levels[name])
        return [(name, F.col(f"`{name}`").cast("double"))]

    out: list[tuple[str, Column, str]] = [(n, c, v) for v in formula.mains for n, c in parts(v)]
    for term in formula.interactions:
        if len(term) > 2:
            warnings.warn(f"interaction {':'.join(term)} has more than two columns and is skipped", stacklevel=3)
            continue
        out += [(f"{n}:{m}", a * b, ":".join(term)) for n, a in parts(term[0]) for m, b in parts(term[1])]
    if not out:
        raise ValueError("the formula gives no design columns")
    return Design([n for n, _, _ in out], [c for _, c, _ in out], [t for _, _, t in out], {f: levels[f] for f in factors})
