r"""Document fingerprints from prefix polynomial hashes.

For code points c_0, c_1, ... and two bases, H[i] = sum of c_j * B^j for j < i modulo 2^31 - 1. Then
(H[j] - H[i]) * B^-i is the hash of the span i..j wherever it stands, so any two spans compare in constant time,
and the longest common extension of two places is found by binary search over its length.

A fingerprint is the text's length, the hash of the whole text (62 bits) and a sketch: the 64 smallest
mixed hashes of its spans of `span` code points. Likeness of two fingerprints is the share of the text they
have in common, 2J / (1 + J) for the Jaccard likeness J of the span sets as estimated from the sketches; it is 1 for
equal lengths and whole hashes.

Scale: the query's successor in doc_id order needs neighbours, not one sorted task: rows go to ranges of
doc_id between quantiles, and the first rows of each range also to the range before it. Texts are shuffled
once; a task holds two documents at a time. What the driver holds is a few numbers per partition.

Null text counts as empty (fingerprint of no spans). Rows of equal doc_id are ordered by text; a null doc_id
comes first. The successor of the last row is the first; a single row is its own. An empty table gives no
rows. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 998_244_353)
SPAN, SKETCH = 16, 64
#: Ranges of doc_id per partition.
RANGES = 6


def reduce_mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for uint64 below 2^62."""
    shift = np.uint64(31)
    x = (x & P) + (x >> shift)
    x = (x & P) + (x >> shift)
    x[x == P] = 0
    return x


class _Powers:
    """Powers of a base and of its inverse, as far as they have been needed."""

    def __init__(self, base: int):
        self.both = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.roots = (base, pow(base, -1, int(P)))

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.both[0]) < n:
            size = len(self.both[0])
            self.both = [np.concatenate([p, reduce_mod(p * np.uint64(pow(r, size, int(P))))]) for p, r in zip(self.both, self.roots)]
        return self.both


_POWERS = [_Powers(b) for b in BASES]


class Prefixes:
    """The two prefix arrays of a text's code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        wide = codes.astype(np.uint64) + np.uint64(1)
        self.arrays = []
        for powers in _POWERS:
            power = powers.upto(self.n + 1)[0]
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(reduce_mod(wide * power[: self.n]), out=h[1:])
            self.arrays.append(reduce_mod(h))

    def spans(self, length: int, which: int = 0) -> np.ndarray:
        """Hashes of all spans of a length."""
        h, inverse = self.arrays[which], _POWERS[which].upto(self.n + 1)[1]
        return reduce_mod(reduce_mod(h[length:] + P - h[: self.n + 1 - length]) * inverse[: self.n + 1 - length])

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash of the span i..j."""
        return tuple((int(h[j]) - int(h[i])) % int(P) * int(p.upto(i + 1)[1][i]) % int(P) for h, p in zip(self.arrays, _POWERS))


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common span that starts at i in a and at j in b."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def fingerprint(p: Prefixes, span: int = SPAN, size: int = SKETCH) -> str:
    """length-whole-sketch, in hexadecimal."""
    own = p.spans(min(span, p.n)) if p.n else np.empty(0, np.uint64)
    mixed = ((own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    if len(mixed) > 4 * size:
        # equal spans have equal hashes: take more until `size` different ones are there
        take = 2 * size
        while take < len(mixed) and len(np.unique(low := np.partition(mixed, take)[:take])) < size:
            take *= 4
        mixed = low if take < len(mixed) else mixed
    sketch = np.unique(mixed)[:size]
    whole = p.span(0, p.n)
    return f"{p.n:x}-{whole[0]:08x}{whole[1]:08x}-" + sketch.astype(">u4").tobytes().hex()


def likeness(a: str, b: str, size: int = SKETCH) -> float:
    (head_a, sketch_a), (head_b, sketch_b) = a.rsplit("-", 1), b.rsplit("-", 1)
    if head_a == head_b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (sketch_a, sketch_b))
    lowest = np.union1d(x, y)[:size]
    if not len(lowest):
        return 0.0
    shared = len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), lowest, assume_unique=True)) / len(lowest)
    return 2 * shared / (1 + shared)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def fingerprints(docs: DataFrame, *, span: int = SPAN, size: int = SKETCH) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for t in batch.column(1):
                codes = codes_of(t.as_py() or "")
                n.append(len(codes))
                out.append(fingerprint(Prefixes(codes), span, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, fingerprint string")


def _range_of(key: Column, cuts: list[float]) -> Column:
    """Number of cuts up to key, in two steps of about sqrt(len(cuts)) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def numbers(xs: list[float]) -> Column:
        return F.array(*(F.lit(int(x)) for x in xs))

    first = F.size(F.filter(numbers([b[0] for b in blocks]), lambda x: x <= key))
    inside = F.get(F.array(*(numbers(b) for b in blocks)), first - 1)
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * step + F.size(F.filter(inside, lambda x: x <= key)))


def with_next(docs: DataFrame) -> DataFrame:
    """_range, _guest, doc_id, text with, sorted inside each partition, every range followed by guest rows: the first rows of the next range (of the first range, for the last)."""
    n = partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    m = RANGES * n  # ranges fall into partitions by hash: several in each even them out
    cuts = sorted(set(map(float, ids.stat.approxQuantile("key", [i / m for i in range(1, m)], 1 / (4 * m))))) if n > 1 else []
    cuts = [c for c in cuts if -(2.0**63) < c < 2.0**63]
    own = _range_of(key, cuts)
    firsts = {r["r"]: r["key"] for r in ids.select("key").groupBy(_range_of(F.col("key"), cuts).alias("r")).agg(F.min("key").alias("key")).collect()}
    order = sorted(firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    all_ranges = range(len(cuts) + 1)
    first = F.get(F.array(*(F.lit(firsts.get(r)).cast("long") for r in all_ranges)), own)
    previous = F.get(F.array(*(F.lit(before.get(r)).cast("int") for r in all_ranges)), own)
    host = F.struct(own.alias("_range"), F.lit(0).alias("_guest"))
    guest = F.struct(previous.alias("_range"), F.lit(1).alias("_guest"))
    to = F.when(key == first, F.array(host, guest)).otherwise(F.array(host))
    rows = docs.select("doc_id", "text", F.explode(to).alias("to")).select("to._range", "to._guest", "doc_id", "text")
    return rows.repartition(n, "_range").sortWithinPartitions("_range", "_guest", "doc_id", "text")


def compare_edits(docs: DataFrame, *, span: int = SPAN, size: int = SKETCH) -> DataFrame:
    """Each text against its edit (the last quarter replaced by the start of the next document) and against the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and common_start: code points
    that text and edit have in common from the start, by binary search over the prefix hashes.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_start"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done))
            done.clear()
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        last = None  # range, doc_id, code points, prefixes, fingerprint
        for b in batches:
            kind = b.schema.field(2).type
            for r, guest, doc, text in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                r, guest = r.as_py(), guest.as_py()
                if guest and (last is None or last[0] != r):
                    continue  # only the first guest of a range is a successor
                codes = codes_of(text.as_py() or "")
                p = Prefixes(codes)
                f = fingerprint(p, span, size)
                if last is not None and last[0] == r:
                    _, doc_id, own, own_p, own_f = last
                    tail = len(own) // 4
                    edited = np.concatenate([own[: len(own) - tail], codes[:tail]])
                    e = Prefixes(edited)
                    e_f = fingerprint(e, span, size)
                    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    done.append((doc_id, len(own), sha, own_f, e_f, likeness(own_f, e_f, size), likeness(own_f, f, size), common_extension(own_p, 0, e, 0)))
                    if len(done) >= 500:
                        yield batch()
                last = None if guest else (r, doc.as_py(), codes, p, f)
        if done:
            yield batch()

    return with_next(docs).mapInArrow(run, schema)
