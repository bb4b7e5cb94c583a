"""Categorical columns: levels, reference levels, bins and names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: More distinct values than this are no factor.
MAX_LEVELS = 10_000


def is_categorical(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def distinct_levels(df: DataFrame, names: list[str], limit: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct values of each column, in one pass after an estimate of their number; more than `limit` levels can't be a factor and raise an error."""
    if not names:
        return {}
    about = df.agg(*(F.approx_count_distinct(F.col(f"`{n}`")) for n in names)).first()  # bounded, so no set of very many values is built
    for n, count in zip(names, about):
        if count > 2 * limit:
            raise ValueError(f"{n} has about {count} levels")
    row = df.agg(*(F.slice(F.sort_array(F.collect_set(F.col(f"`{n}`"))), 1, limit + 1).alias(f"l{k}") for k, n in enumerate(names))).first()
    for n, levels in zip(names, row):
        if len(levels) > limit:
            raise ValueError(f"{n} has more than {limit} levels")
    return {n: list(levels) for n, levels in zip(names, row)}


def relevel(levels: list[str], reference: str) -> list[str]:
    """levels with reference in front."""
    if reference not in levels:
        raise ValueError(f"{reference!r} is not a level")
    return [reference, *(v for v in levels if v != reference)]


def bin_counts(count: Column, top: int = 3) -> Column:
    """0, 1, 2, 3+ of a count; null stays null."""
    return F.when(count >= top, F.lit(f"{top}+")).otherwise(count.cast("int").cast("string"))


def safe_name(name: str) -> str:
    """A column name of letters, digits and underscores."""
    clean = re.sub(r"\W", "_", name)
    return clean if re.match(r"[A-Za-z_]", clean) else f"X{clean}"
