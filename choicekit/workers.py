"""Python workers and this package; how many tasks a shuffle needs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of choices that one task sorts, about: what it holds of them grows with this, not with the table.
TASK_ROWS = 500_000


def tasks(spark: SparkSession, n_rows: int) -> int:
    """Tasks for a shuffle of n_rows rows: spark.sql.shuffle.partitions, or more where each would get over TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // TASK_ROWS))


def deal(df: DataFrame, n_rows: int, key: str) -> DataFrame:
    """df, dealt by key into tasks of about TASK_ROWS rows of a table of n_rows; as it is where Spark's own shuffles make no larger ones."""
    spark, n = df.sparkSession, -(-n_rows // TASK_ROWS)
    few = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if n <= few else df.repartition(n, key)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver only has it on sys.path."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
