"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources take the weights in turn, by code point (null last), and share `total` times all sizes in
proportion. No source is read more than `epochs` times: a target stops there and the excess is reshared by
weight among the others until none is above. With sources sorted by cap / weight this is one pass: source i
is capped if cap_i * (weights from i on) <= weight_i * (what is left for them).

A source's target is floor(target / size) whole repetitions and a fractional one. The fractional one takes
documents in seeded hash order while they fit, and of the next document as many first words as are left to the target. So a
source's taken words miss its target by less than one word (per repeated row), and one document of a source at most is
cut short.

Scale: running sums go over hash ranges of about `bucket_rows` rows, whose sums give each range its start;
one source may hold most rows. What is decided per source (boundaries in the hash order) is a few numbers;
they reach the rows by a broadcast up to `broadcast_sources` sources and by a join on (source, hash range)
beyond that.

Null text has size 0. Equal doc_ids of equal size in one source are decided together. An empty table gives
no rows; a source without words has target 0. Extra columns are dropped by mix() and kept by apply().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, free_name, materialize
from .sharding import source_key

WEIGHTS, TOTAL, EPOCHS, SEED, BUCKET_ROWS, BROADCAST_SOURCES = (5, 2, 1), 1.5, 2, 11, 2_000, 100_000


def _keyed(docs: DataFrame, seed: int, buckets: int, keep: list[str]) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*keep, source_key(F.col("source")).alias("_k"), size.alias("_size"), key.alias("_key"), F.col("doc_id").alias("_id"))
    return rows.withColumn("_b", F.expr(f"cast(conv(substr(_key, 1, 7), 16, 10) as bigint) * {buckets} div {16**7}"))


def water_fill(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> DataFrame:
    """sources (k, source_size) with weight and target. One row per source: windows over all of them are small."""
    everything = W.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything.orderBy(F.col("k") == "n", "k")) - 1) % len(weights) + 1).cast("int")).cast("double")
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * epochs)
    order = everything.orderBy(F.col("cap") / F.col("weight"), "k")
    x = x.withColumn("from_here", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("left", F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("capped", F.col("cap") * F.col("from_here") <= F.col("weight") * F.col("left"))
    level = F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return x.select("k", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight") / free).alias("target"))


def plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """The rows (doc_id, source, _k, _size, _key, _id, _b), what is decided per source, and the number of hash ranges."""
    buckets = max(1, -(-docs.count() // bucket_rows))
    rows = materialize(_keyed(docs, seed, buckets, ["doc_id", "source"]))
    units = rows.repartition("_k", "_b").groupBy("_k", "_b", "_key", "_id", "_size").agg((F.count(F.lit(1)) * F.col("_size")).alias("u"))
    ranges = rows.groupBy(F.col("_k").alias("k"), F.col("_b").alias("b")).agg(F.sum("_size").alias("s"))
    targets = water_fill(ranges.groupBy("k").agg(F.sum("s").alias("source_size")), weights=weights, total=total, epochs=epochs)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    starts = ranges.withColumn("start", F.sum("s").over(W.partitionBy("k").orderBy("b")) - F.col("s")).join(targets, "k")
    running = F.sum("u").over(W.partitionBy("_k", "_b").orderBy("_key", F.col("_id").asc_nulls_first(), "_size"))
    joined = units.join(starts, (F.col("_k") == F.col("k")) & (F.col("_b") == F.col("b")))
    summed = materialize(joined.select("_k", "_b", "_key", "_id", "_size", "u", "source_size", "target", "whole", "rest", (F.col("start") + running).alias("cum")))
    unit = F.struct("_key", F.col("_id").isNotNull().alias("is"), "_id", "_size")
    fits = F.col("cum") <= F.col("rest")
    per = summed.groupBy("_k").agg(
        *(F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")), F.max(F.when(fits, unit)).alias("last"), F.coalesce(F.max(F.when(fits, F.col("cum"))), F.lit(0)).alias("got"),
        F.min(F.when(~fits, F.struct(unit.alias("unit"), "u"))).alias("next"),
    )
    # rows of equal doc_id and size share what is left
    part = F.floor((F.col("rest") - F.col("got")) * F.col("next.unit._size") / F.col("next.u"))
    return rows, materialize(per.select("_k", "source_size", "target", "whole", "last", F.col("next.unit").alias("cut"), F.coalesce(part, F.lit(0)).cast("long").alias("part"))), buckets


def _decided(rows: DataFrame, per: DataFrame, buckets: int, broadcast_sources: int) -> DataFrame:
    """rows with source_size, target, the whole repetitions `times` and the words `more` of one that is cut short."""
    if per.limit(broadcast_sources + 1).count() <= broadcast_sources:
        x = rows.join(F.broadcast(per), "_k")
    else:
        spread = per.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumn("_b", F.col("_b").cast("long"))
        x = rows.join(spread, ["_k", "_b"])
    unit = F.struct("_key", F.col("_id").isNotNull().alias("is"), "_id", "_size")
    extra = F.coalesce(unit <= F.col("last"), F.lit(False))
    more = F.when(F.coalesce(unit == F.col("cut"), F.lit(False)), F.col("part")).otherwise(F.lit(0)).cast("long")
    return x.withColumn("times", F.col("whole") + extra.cast("long")).withColumn("more", more)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """doc_id, source, size, source_size, target, times, more, taken (= times * size + more) of every row."""
    rows, per, buckets = plan(docs, weights=weights, total=total, epochs=epochs, seed=seed, bucket_rows=bucket_rows)
    x = _decided(rows, per, buckets, broadcast_sources)
    return x.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "times", "more", (F.col("times") * F.col("_size") + F.col("more")).alias("taken"))


def apply(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mixture itself: each row of docs, with all its columns, as often as mix() takes it, and where it takes `more` words once with the first of its words only (n_chars, where there is one, follows)."""
    _, per, buckets = plan(docs, weights=weights, total=total, epochs=epochs, seed=seed, bucket_rows=bucket_rows)
    whole = free_name(docs, "_row")
    rows = _keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), "doc_id", "source", "text"), seed, buckets, [whole])
    x = _decided(rows, per, buckets, broadcast_sources)
    copies = F.array_repeat(F.lit(-1).cast("long"), F.col("times").cast("int"))
    x = x.select(whole, F.explode(F.when(F.col("more") > 0, F.concat(copies, F.array("more"))).otherwise(copies)).alias("_words"))
    row = F.col(whole)
    short = first_words(row["text"], F.col("_words"))
    changed = {"text": short}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(short).cast(dict(docs.dtypes)["n_chars"])
    return x.select(*(F.when(F.col("_words") < 0, row[c]).otherwise(changed[c]).alias(c) if c in changed else row[c].alias(c) for c in docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """text from its first word to the end of its n-th (n > 0, and there are more)."""
    trimmed = F.regexp_replace(text, rf"^{SPACE}", "")
    rest = F.element_at(F.split(trimmed, SPACE, (n + 1).cast("int")), -1)
    return F.regexp_replace(F.left(trimmed, F.length(trimmed) - F.length(rest)), rf"{SPACE}$", "")


#: What mix() gives for `documents`, as one statement over whole tables.
ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                      md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
             CAST(source_size AS DOUBLE) * 2 AS cap FROM src),
f AS (SELECT *, sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here,
             CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w),
c AS (SELECT *, cap * from_here <= w * rest AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
        (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w
        / sum(CASE WHEN NOT capped THEN w END) OVER () END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
u AS (SELECT source, k, doc_id, size, CAST(sum(size) AS BIGINT) AS u FROM sized GROUP BY source, k, doc_id, size),
r AS (SELECT u.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             sum(u) OVER (PARTITION BY u.source ORDER BY k, doc_id NULLS FIRST, size) AS cum
      FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source),
g AS (SELECT source, any_value(rest) - coalesce(max(CASE WHEN cum <= rest THEN cum END), 0) AS gap FROM r GROUP BY source),
q AS (SELECT source, k, doc_id, size, gap, u FROM (
        SELECT r.*, gap, row_number() OVER (PARTITION BY r.source ORDER BY k, doc_id NULLS FIRST, size) AS n
        FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE cum > rest) WHERE n = 1)
SELECT s.doc_id, s.size, r.source_size, r.target,
       CAST(s.size * (r.whole + CASE WHEN r.cum <= r.rest THEN 1 ELSE 0 END) + coalesce(floor(q.gap * q.size / q.u), 0) AS BIGINT) AS taken
FROM sized s
JOIN r ON s.source IS NOT DISTINCT FROM r.source AND s.k = r.k AND s.doc_id IS NOT DISTINCT FROM r.doc_id AND s.size = r.size
LEFT JOIN q ON s.source IS NOT DISTINCT FROM q.source AND s.k = q.k AND s.doc_id IS NOT DISTINCT FROM q.doc_id AND s.size = q.size
"""
