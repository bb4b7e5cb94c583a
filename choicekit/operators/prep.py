"""Filters and transforms of a study's choice table before the fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_filter(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def equal_filter(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with that value, without the column."""
    return df.filter(F.col(column) == F.lit(value)).drop(column)


def chosen_attribute(df: DataFrame, stratum: str, choice: str, column: str, order_by: list[str]) -> DataFrame:
    """stratum and the attribute of its first chosen row; only one row a set is shuffled on the way."""
    first = F.min(F.struct(*order_by, F.col(column).alias("_a")))
    return df.filter(F.col(choice) == 1).groupBy(stratum).agg(first.alias("f")).select(stratum, F.col("f._a").alias("chosen_value"))


def group_range_filter(df: DataFrame, stratum: str, choice: str, column: str, low, high, order_by: list[str]) -> DataFrame:
    """Rows of the sets whose chosen row has column between low and high."""
    keep = chosen_attribute(df, stratum, choice, column, order_by).filter(F.col("chosen_value").between(low, high)).select(stratum)
    return df.join(keep, stratum, "left_semi")


def restrict(df: DataFrame, stratum: str, choice: str, condition: Column, rest: bool = True) -> DataFrame:
    """Sets whose chosen row meets the condition; with rest, other rows that fail it go too."""
    keep = df.filter((F.col(choice) == 1) & condition).select(stratum).distinct()
    out = df.join(keep, stratum, "left_semi")
    return out.filter((F.col(choice) == 1) | condition) if rest else out


def n_sets(df: DataFrame, stratum: str) -> int:
    return df.agg(F.countDistinct(stratum)).first()[0]


def scale_factors(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, factor): the standard deviation of columns that aren't 0/1 and vary by more than 1, else 1."""
    one = df.agg(*(F.struct(F.stddev_samp(c).alias("sd"), F.bool_and(F.col(c).isin(0.0, 1.0)).alias("binary")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.when(~F.col(f"{c}.binary") & (F.col(f"{c}.sd") > 1), F.col(f"{c}.sd")).otherwise(F.lit(1.0)).alias("factor")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.name", "r.factor")


def sampling_offset(df: DataFrame, stratum: str, sampled: str, population: Column) -> Column:
    """-ln(n_s / N_s): n_s rows of the set come from a sampling stratum of N_s."""
    from pyspark.sql import Window as W

    return -F.log(F.count(F.lit(1)).over(W.partitionBy(stratum, sampled)) / population)
