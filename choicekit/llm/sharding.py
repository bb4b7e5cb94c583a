"""Shards that all match the mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; row r of N in its source has the
fractional rank (2r - 1) / 2N. In the order of fractional ranks every stretch holds each source in
proportion, so cutting it into stretches of equal length gives shards whose row counts differ by one at
most (the law `rows`) and whose share of every source differs by about one row.

Scale: a source may hold most rows, so ranks are not taken in one window per source. Hash ranges within
the source (and ranges of the fractional rank) hold about `bucket_rows` (times 10) rows each; their counts give each
range its first rank, and only the rows inside a range are sorted together. The text is hashed and
measured at the scan and never shuffled.

Null sources are a source of their own; null text has size 1 and checksum 0. Repeated rows are dealt like
any others. With fewer rows than shards the first shards get one row each. An empty table gives no rows.
Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SHARDS, SEED, BUCKET_ROWS = 16, 7, 2_000


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def interleave(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row."""
    n = docs.count()
    buckets, cuts = max(1, -(-n // bucket_rows)), max(1, -(-n // (10 * bucket_rows)))
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("k"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(raw, "utf-8")).alias("text_crc32"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"),
    ).withColumn("b", F.floor(F.shiftrightunsigned("h", 33) * F.lit(buckets) / F.lit(float(1 << 31))).cast("long"))
    keys = docs.select(source_key(F.col("source")).alias("k"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"))
    counts = keys.groupBy("k", F.floor(F.shiftrightunsigned("h", 33) * F.lit(buckets) / F.lit(float(1 << 31))).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("k", "b", F.sum("c").over(W.partitionBy("k")).alias("n_source"), (F.sum("c").over(W.partitionBy("k").orderBy("b")) - F.col("c")).alias("before"))
    tie = ["h", "doc_id", "text_crc32", "size"]
    ranked = rows.join(before, ["k", "b"]).withColumn("r", F.col("before") + F.row_number().over(W.partitionBy("k", "b").orderBy(*tie)))
    odd = 2 * F.col("r") - 1
    ranked = materialize(
        ranked.select("doc_id", "source", "k", "size", "text_crc32", "r", (odd / (2 * F.col("n_source"))).alias("f"), F.expr(f"(2 * r - 1) * {cuts} div (2 * n_source)").alias("fb"))
    )
    starts = ranked.groupBy("fb").agg(F.count(F.lit(1)).alias("c")).select("fb", (F.sum("c").over(W.orderBy("fb")) - F.col("c")).alias("start"))
    placed = ranked.join(starts, "fb").withColumn("at", F.col("start") + F.row_number().over(W.partitionBy("fb").orderBy("f", "k", "r")) - 1)
    low, more = divmod(n, shards)
    cut = more * (low + 1)  # rows in the shards that get one more
    in_more = F.col("at") < cut
    shard = F.when(in_more, F.expr(f"at div {low + 1}")).otherwise(more + F.expr(f"(at - {cut}) div {max(low, 1)}"))
    slot = F.when(in_more, F.col("at") % (low + 1)).otherwise((F.col("at") - cut) % max(low, 1))
    return placed.select("doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write docs (whose doc_ids are unique) to path/shard=NN, each sorted by slot. A shard larger than one task should hold is split by maxRecordsPerFile."""
    dealt = interleave(docs, shards=shards, seed=seed).select("doc_id", "shard", "slot")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    kept.join(dealt, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
