r"""SimHash near-dedup with pigeonring filtering.

A text's words are runs of non-space characters of the text with A-Z lower-cased; its shingles are `k` words
joined by a space (fewer words: the whole sequence), repeats included. A fingerprint bit is 1 if it is set in
over half of the shingles' XXH64 hashes (seed 42). Two fingerprints link at `distance` (4) or fewer differing bits.

Candidates: the 64 bits are a ring of 8 segments. By the pigeonring principle a pair within 4 bits has a
segment from which every chain of l segments has at most l * 4 / 8 differences: 0, 1, 1, 2, 2, 3, 3, 4. So
in the first 3 segments of such a chain 2 are equal, in the first 5 three, in the first 7 four, with the
first among them. Those equal segments are the keys (16, 24 or 32 bits, 16 to 70 keys a fingerprint, chosen by
the number of fingerprints so that chance meetings stay few), and of two fingerprints that share a key only
those whose chain keeps its budgets all the way round are linked; the last budget is the full Hamming check.
near_sets() takes the same ring at 6 bits, where 2 of the first 5 segments are equal, besides min-hash keys.

Scale: only distinct fingerprints meet, so copies cost nothing. No pair table exists: a task reads the
fingerprints of a key in a row and emits a spanning forest of their links, at most 32 edges a
fingerprint and key for short runs and one for long ones, where linked fingerprints leave the
search at once, so that a dense group of near copies takes near-linear time. It holds 8 bytes for each distinct
fingerprint of one key. Components come from components.py.

Null and empty texts have fingerprint 0 and link like any other. Repeated rows are rows of their own. Null
doc_ids never become a component's id unless it has no other. An empty table gives no rows. Extra columns
are dropped by components() and kept by dedup(). dedup() keeps one row of a component, whatever doc_ids its rows share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean, materialize, partitions, ship
from .components import connected_components

SHINGLE, SEED, DISTANCE, SEGMENTS = 4, 42, 4, 8
#: Runs up to this length are compared pair by pair, longer ones are searched.
SHORT = 32


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Unsigned 64 bits of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxh64_intdigest(joined, SEED)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    n = len(words) - k + 1
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, 64)
    whole = n // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.encode("text", "utf-8").alias("text")).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _fingerprints(docs: DataFrame, k: int, row: str) -> DataFrame:
    """doc_id, row (the column of that name), fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", k) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    return docs.select("doc_id", F.col(row).alias("row"), F.encode("text", "utf-8").alias("text")).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, row long, fp long")


def chain_keys(length: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(start, mask) of the segment sets that the first `length` segments (for 4 bits 3, 5 or 7) of a chain have in common: the first, and enough of the rest for every budget. `distance` is below SEGMENTS."""
    sets = [(0,)]
    for upto in range(2, length + 1):
        if upto - upto * distance // SEGMENTS == len(sets[0]):
            continue
        sets = sorted({tuple(sorted({*s, e})) for s in sets for e in range(1, upto) if e not in s})
    out, seen = [], set()
    for start in range(SEGMENTS):
        for s in sets:
            on = frozenset((start + x) % SEGMENTS for x in s)
            mask = sum(0xFF << (8 * x) for x in on)
            if (start, mask) not in seen:
                seen.add((start, mask))
                out.append((start, mask))
    return out


def chain_length(n: int) -> int:
    return 3 if n <= 1 << 22 else 5 if n <= 1 << 29 else 7


def near(x: np.ndarray, start: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which differences x (uint64) keep the budgets of the whole ring from segment `start` on; the last one is the Hamming distance."""
    ones = np.bitwise_count(x.astype("<u8").view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int64)
    turned = np.take_along_axis(ones, (start[:, None] + np.arange(SEGMENTS)) % SEGMENTS, axis=1)
    return (np.cumsum(turned, axis=1) <= np.arange(1, SEGMENTS + 1) * distance // SEGMENTS).all(axis=1)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Positions (member, root) of the components of distinct fps under the full Hamming check, roots left out."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left):
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            hit = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= distance
            found = left[hit].tolist()
            out += [(x, root) for x in found]
            front += found
            left = left[~hit]
    return out


def _links(keys: np.ndarray, fps: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among whole runs of equal keys; the low byte of a key is the number of its segment set."""
    a, b = [], []
    edges = np.flatnonzero(np.diff(keys)) + 1
    begin, size = np.concatenate([[0], edges]), np.diff(np.concatenate([[0], edges, [len(keys)]]))
    for at, n in zip(begin[size > SHORT].tolist(), size[size > SHORT].tolist()):
        own = fps[at : at + n]
        found = np.array(forest(own, distance), np.int64).reshape(-1, 2)
        a.append(own[found[:, 0]])
        b.append(own[found[:, 1]])
    short = np.repeat(size <= SHORT, size)
    keys, fps = keys[short], fps[short]
    for d in range(1, min(SHORT, len(keys))):
        i = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(i):
            break
        x = fps[i] ^ fps[i + d]
        i = i[near(x, starts[(keys[i] & 0xFF).astype(np.int64)], distance)]
        a.append(fps[i])
        b.append(fps[i + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2


def links(fps: DataFrame, length: int, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp whose components are those of all pairs within the distance."""
    keys = chain_keys(length, distance)
    start_of = np.array([s for s, _ in keys], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(k, f):
            x, y = _links(k, f, start_of, distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for batch in batches:
            new = batch.column(0).to_numpy(zero_copy_only=False)
            key, fp = np.concatenate([key, new]), np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) and key[0] != key[-1]:
                last = int(np.searchsorted(key, key[-1]))  # sorted by key
                yield out(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield out(key, fp)

    signed = [m - (1 << 64) if m >> 63 else m for _, m in keys]
    tagged = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).bitwiseAND(F.lit(-256)).bitwiseOR(F.lit(i)) for i, m in enumerate(signed)))
    n = partitions(fps.sparkSession)
    return fps.select(F.explode(tagged).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(run), "a long, b long")


def components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of each row; component_id is the smallest doc_id reachable by links."""
    rows = materialize(fingerprints(docs, k))
    return _components(rows)


def _components(rows: DataFrame) -> DataFrame:
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(distinct.select("fp"), chain_length(distinct.count())))
    # every node of a component, its root too, with the component's smallest doc_id
    member = found.union(found.select("component", "component").distinct())
    member = member.join(distinct, member.node == distinct.fp).select("node", "component", "least")
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of = member.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    of = distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(materialize(of), "fp", "left").select("doc_id", "fp", "component_id")


#: Differing bits up to which near_sets() links fingerprints by the ring; the first 5 segments of a chain have 2 equal ones (32 keys of 16 bits).
RING, RING_LENGTH = 6, 5
#: Keys of near_sets(): BANDS groups of ROWS min-hashes. A pair of likeness 0.8 shares no key once in 38,000.
BANDS, ROWS = 20, 4
#: Differing bits up to which fingerprints that share a key are looked at: pairs of likeness 0.8 differ in 10, unrelated ones in 32.
WIDE = 26
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles; fewer than k words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(np.array([xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(max(1, len(words) - k + 1))], np.uint64))


def _majority(own: np.ndarray) -> int:
    bits = np.unpackbits(own.view(np.uint8), bitorder="little").reshape(len(own), 64)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own), bitorder="little").view("<u8")[0])


def sketch(own: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(set id, fingerprint, keys) of a shingle set; the fingerprint counts each shingle once."""
    from xxhash import xxh64_intdigest

    if not len(own):
        return 0, 0, np.empty(0, np.int64)
    fp = np.uint64(_majority(own)).view(np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        h = own[at : at + 2048, None] * _MIX[0] + _MIX[1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, h.min(axis=0))
    keys = [xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return xxh64_intdigest(own.tobytes(), 1) - (1 << 63), int(fp), np.array(keys, np.uint64).view(np.int64)


def alike(sets: list[np.ndarray], fps: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Positions (member, root) of the components that the pairs of likeness `similarity` and more form, roots left out."""
    out: list[tuple[int, int]] = []
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    while len(left):
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            x = front.pop()
            low, high = np.minimum(sizes[left], sizes[x]), np.maximum(sizes[left], sizes[x])
            may = np.flatnonzero((low >= similarity * high - 1e-9) & (np.bitwise_count(fps[left] ^ fps[x]) <= WIDE))
            hit = np.zeros(len(left), bool)
            for i in may.tolist():
                other = sets[left[i]]
                at = np.searchsorted(sets[x], other)
                both = int((sets[x][np.minimum(at, len(sets[x]) - 1)] == other).sum())
                hit[i] = both >= similarity * (len(sets[x]) + len(other) - both) - 1e-9
            found = left[hit].tolist()
            out += [(y, root) for y in found]
            front += found
            left = left[~hit]
    return out


def near_sets(docs: DataFrame, k: int, similarity: float, row: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, set_id of each row; node, component of the sets that have one of exact Jaccard likeness `similarity` or more).

    Sets meet by the ring, as in components(), where their fingerprints differ in RING bits at most. At likeness 0.8 many differ
    in more, too many for segments to be equal, so all sets meet by min-hash keys as well, within WIDE bits.
    Those that meet form rough components; each is read by one task, which compares the shingle sets.
    """
    kind = dict(docs.dtypes)["doc_id"]
    text = F.encode("text", "utf-8").alias("text")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sketch(shingles(t.as_py() or b"", k)) for t in b.column(2)]
            cols = [pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "row", "set_id", "fp", "keys"])

    rows = materialize(docs.select("doc_id", F.col(row).alias("row"), text).mapInArrow(lean(sketches), f"doc_id {kind}, row long, set_id long, fp long, keys array<long>"))
    first = rows.groupBy("set_id").agg(F.min("row").alias("row"))
    distinct = rows.join(first, ["set_id", "row"]).dropDuplicates(["set_id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def pairs(key, sid, fp) -> pa.RecordBatch:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            edges = np.flatnonzero(np.diff(key)) + 1
            begin, size = np.concatenate([[0], edges]), np.diff(np.concatenate([[0], edges, [len(key)]]))
            for at, n in zip(begin[size > SHORT].tolist(), size[size > SHORT].tolist()):
                found = np.array(forest(fp[at : at + n], WIDE), np.int64).reshape(-1, 2) + at
                a.append(sid[found[:, 0]])
                b.append(sid[found[:, 1]])
            short = np.repeat(size <= SHORT, size)
            key, sid, fp = key[short], sid[short], fp[short]
            for d in range(1, min(SHORT, len(key))):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= WIDE]
                a.append(sid[i])
                b.append(sid[i + d])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new[2] = new[2].view(np.uint64)
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            if len(rest[0]) and rest[0][0] != rest[0][-1]:
                cut = int(np.searchsorted(rest[0], rest[0][-1]))
                yield pairs(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield pairs(*rest)

    n = partitions(docs.sparkSession)
    edges = distinct.select(F.explode("keys").alias("key"), "set_id", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(meet), "a long, b long")
    heads = materialize(distinct.filter("size(keys) > 0").select("set_id", "fp"))
    leads = materialize(heads.groupBy("fp").agg(F.min("set_id").alias("lead")))
    equal = heads.join(leads, "fp").select(F.col("set_id").alias("a"), F.col("lead").alias("b"))
    ring = links(leads.select("fp"), RING_LENGTH, RING)
    for end in ("a", "b"):
        ring = ring.join(leads.select(F.col("fp").alias(end), F.col("lead").alias(f"_{end}")), end)
    ring = ring.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    rough = connected_components(edges.union(ring).union(equal))
    members = rough.union(rough.select("component", "component").distinct())
    asked = materialize(members.join(first, members["node"] == first["set_id"]).select("component", "set_id", F.col("row").alias("_row_of")))
    texts = docs.join(asked, docs[row] == asked["_row_of"]).select("component", "set_id", text)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, sids, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = alike(sets, np.array([_majority(x) for x in sets], np.uint64), similarity)
            return pa.RecordBatch.from_arrays([pa.array([sids[i] for i, _ in found], pa.int64()), pa.array([sids[j] for _, j in found], pa.int64())], ["node", "component"])

        for b in batches:
            for c, sid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if c != which:
                    if len(sids) > 1:
                        yield done()
                    which, sids, sets = c, [], []
                if not sids or sids[-1] != sid:  # repeated rows
                    sids.append(sid)
                    sets.append(shingles(t.as_py() or b"", k))
        if len(sids) > 1:
            yield done()

    found = texts.repartition(n, "component").sortWithinPartitions("component", "set_id").mapInArrow(lean(compare), "node long, component long")
    return rows.select("doc_id", "row", "set_id"), materialize(found)


def dedup(docs: DataFrame, k: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of each component of docs, with all its columns: that of the smallest doc_id, nulls last; of several rows with it, that of the smallest hash of the row.

    Components are those of components(), or, with `similarity`, those of near_sets(). A component follows from
    the text alone, so rows that share a doc_id, null or not, fall away only where their texts are near copies.
    """
    ship(docs.sparkSession)
    hashed = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    row, part = free_name(docs, "_row"), free_name(docs, "_part")
    docs = docs.withColumn(row, F.xxhash64(*hashed))
    if similarity is None:
        rows = materialize(_fingerprints(docs, k, row))
        found = connected_components(links(materialize(rows.select("fp").distinct()), chain_length(rows.select("fp").distinct().count())))
        node = "fp"
    else:
        rows, found = near_sets(docs, k, similarity, row)
        node = "set_id"
    rows = rows.join(found.select(F.col("node").alias(node), "component"), node, "left")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    kept = rows.groupBy(F.coalesce("component", node).alias(part)).agg(F.min(order).alias("least"))
    kept = materialize(kept.select(part, F.col("least.doc_id").alias("_id_of"), F.col("least.row").alias("_row_of")))
    out = docs.join(kept, (docs[row] == kept["_row_of"]) & docs["doc_id"].eqNullSafe(kept["_id_of"]))
    return out.dropDuplicates([part]).select(*[F.col(f"`{c}`") for c in docs.columns if c != row])
