"""Choice sets packed for the kernel: whole sets, ordered inside, many to a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..workers import ship, tasks


def group_bounds(df: DataFrame, stratum: str) -> DataFrame:
    """stratum, size and the 0-based start of its run in the order of strata.

    Sets are dealt in ranges of their keys; a range's rows are summed, and what ranges before it have is added to
    the running total inside it. One number per range is all that comes together in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    ranged = sizes.repartitionByRange(n, stratum).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    total = ranged.groupBy("_range").agg(F.sum("size").alias("_n"))
    before = total.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.sum("size").over(W.partitionBy("_range").orderBy(stratum)) - F.col("size")
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(stratum, "size", (F.col("_before") + F.col("_inside")).alias("start"))


def rows_of(df: DataFrame, *, stratum: str, y: Column, x: list[Column], offset: Column | None, cluster: str | None, order_by: list[str]) -> DataFrame:
    """The projection that pack() takes: nothing else is shuffled."""
    return df.select(
        F.col(f"`{stratum}`").alias("stratum"), (F.col(f"`{cluster}`") if cluster else F.lit(0)).alias("cluster"), *(F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order_by)),
        y.cast("int").alias("y"), (offset.cast("double") if offset is not None else F.lit(0.0)).alias("off"), *(c.alias(f"x{i}") for i, c in enumerate(x)),
    )


def pack(rows: DataFrame, n_columns: int, n_rows: int | None = None) -> DataFrame:
    """rows_of() to blocks of whole choice sets, about one Arrow batch of rows each. n_rows: how many rows there are, about, if that is known; else they are counted.

    cluster, k, n_chosen, n_clusters, chosen: arrays with an entry per set (its first row's cluster; its rows; its chosen rows; 1 or 2
    for one or several clusters; the 0-based place of its first chosen row, or -1), off and x: arrays over the
    block's rows. One shuffle on the set; a set is never split, so it must fit into a task.
    """
    ship(rows.sparkSession)
    order = [c for c in rows.columns if c[0] == "o" and c != "off"]
    kind = dict(rows.dtypes)["cluster"]
    names = ["cluster", "k", "n_chosen", "n_clusters", "chosen", "off", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            stratum, cluster = (table.column(i).chunk(0) for i in (0, 1))
            n = table.num_rows
            new = np.concatenate([[True], pc.not_equal(stratum.slice(1), stratum.slice(0, n - 1)).to_numpy(zero_copy_only=False)]) if n > 1 else np.array([True])
            start = np.flatnonzero(new)
            k = np.diff(np.append(start, n))
            y = table.column(2).to_numpy()
            first = np.minimum.reduceat(np.where(y == 1, np.arange(n), n), start)
            own = cluster.take(pa.array(np.repeat(start, k)))
            mixed = np.maximum.reduceat(pc.not_equal(cluster, own).to_numpy(zero_copy_only=False).astype(np.int32), start)
            x = np.stack([table.column(4 + i).to_numpy() for i in range(n_columns)], axis=1).ravel()
            cells = [cluster.take(pa.array(start)), *(pa.array(v.astype(np.int32)) for v in (k, np.add.reduceat(y, start), 1 + mixed, np.where(first < n, first - start, -1))), table.column(3).chunk(0), pa.array(x)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells], names)

        for b in batches:
            if not b.num_rows:
                continue
            s = b.column(0)
            if held and s[0] == held[-1].column(0)[-1] and s[0] == s[-1]:
                held.append(b)  # one set goes on
                continue
            # rows before the last set's first row are whole sets
            cut = b.num_rows - 1
            last = pc.equal(s, s[-1]).to_numpy(zero_copy_only=False)
            cut = b.num_rows - int(last.sum())
            if cut or held:
                whole = pa.Table.from_batches([*held, b.slice(0, cut)])
                if whole.num_rows:
                    yield block(whole)
            held = [b.slice(cut)]
        if held:
            yield block(pa.Table.from_batches(held))

    n = tasks(rows.sparkSession, rows.count() if n_rows is None else n_rows)
    dealt = rows.repartition(n, "stratum").sortWithinPartitions("stratum", *order).drop(*order)
    return dealt.mapInArrow(run, f"cluster array<{kind}>, k array<int>, n_chosen array<int>, n_clusters array<int>, chosen array<int>, off array<double>, x array<double>")
