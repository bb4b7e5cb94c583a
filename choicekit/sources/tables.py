"""Reading study tables and writing results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fit import ClogitFit


def read_columns(spark: SparkSession, path: str, needed: list[str], fmt: str = "parquet") -> DataFrame:
    """Those of the needed columns that the table has; Parquet and ORC read nothing else."""
    df = spark.read.format(fmt).load(path)
    return df.select(*[c for c in needed if c in df.columns])


def write_table(table: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = table.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, else in the warehouse."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output (with its _SUCCESS mark) stands at path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(conf).exists(p)


def resumable(spark: SparkSession, path: str | None, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first unless it is there."""
    if path is None:
        return make()
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_fit(spark: SparkSession, fit: ClogitFit, path: str) -> None:
    spark.createDataFrame([(fit.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_fit(spark: SparkSession, path: str) -> ClogitFit:
    return ClogitFit.from_json(spark.read.text(path, wholetext=True).first().value)
