"""Best-fit packing by sums of squares.

A document becomes its token ids and an end id; a document of more than `capacity` ids is cut into
pieces of `capacity` ids and a rest. Every rest is placed by the sum-of-squares rule: with N(g) open
sequences of residual gap g, it goes where the sum of N(g)^2 becomes smallest (a new sequence is one of
the choices; ties take the smallest gap). Rests arrive longest first, so the short ones close the gaps.

Scale: rests meet only in buckets of about `bucket_docs` documents, dealt by a hash of the document id,
so no task sees more than some buckets, whatever the source or the copies; a bucket wastes about one
sequence. Pieces of full length are sequences of their own. Only ids and lengths are shuffled.

Null text counts as empty (one end id). Repeated rows are packed as often as they occur. An empty table
gives no rows. Null ids are kept. Extra columns are dropped: the result has its own columns only.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, ship

CAPACITY, END_ID, BUCKET_DOCS = 4096, 1, 8192
#: Entries of a worker's word cache; about 200 bytes each.
CACHE_WORDS = 600_000

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
_TOKEN = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{_SPACES}{_LETTERS}{_NUMBERS}]+".encode("latin-1"))
_LOWER = bytes(ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256))
_PURE = re.compile(f"[{_LETTERS}]+".encode("latin-1")).fullmatch
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Characters for bytes in vocabularies of byte-level tokenizers: printable ones stand for themselves, the others follow from 256 on.
_BYTE = {b: chr(b) if b in _SHOWN else chr(256 + n) for n, b in enumerate([b for b in range(256) if b not in _SHOWN])} | {b: chr(b) for b in _SHOWN}
#: ASCII separators that str.split() knows and the tokenizer doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class WordBpe:
    """Ids of word_bpe texts as little-endian uint32 bytes, word by word through a cache.

    No token of this vocabulary spans white space, so a text's ids are the ids of its words in a row.
    Texts of Latin-1 characters are cut into words here; others are cut at white space only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.words: dict = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, word: bytes | str) -> bytes:
        if isinstance(word, bytes) and _PURE(word):  # one token of the pre-tokenizer: the merges alone
            text = word.decode("ascii") if word.isascii() else "".join(map(_BYTE.__getitem__, word.decode("latin-1").encode()))
            ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        else:
            ids = self._ids(word if isinstance(word, str) else word.decode("latin-1"))
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[word] = ids
        return ids

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        return map(self._text, texts)

    def _text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._ids(text)
        try:
            words = _TOKEN.findall(text.encode("latin-1").translate(_LOWER))
        except UnicodeEncodeError:
            if _ODD_SPACE.search(text):
                return self._ids(text)
            words = text.split()
        got = list(map(self.words.get, words))
        at = -1
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            known = self.words.get(words[at])
            got[at] = self._learn(words[at]) if known is None else known
        return b"".join(got)


_OPEN: dict[str, WordBpe] = {}


def _tokenizer(path: str) -> WordBpe:
    if path not in _OPEN:
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as array<int>) of each piece of each document."""
    ship(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, texts = part.column(0), part.column(1).to_pylist()
                rows: list[int] = []
                cols: list[list] = [[], [], [], [], []]
                for row, raw in enumerate(bpe([t or "" for t in texts])):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), capacity * 4)):
                        own = raw[a : a + capacity * 4]
                        rows.append(row)
                        cols[0].append(k)
                        cols[1].append(a // 4)
                        cols[2].append(len(own) // 4)
                        cols[3].append(zlib.crc32(own))
                        if keep_ids:
                            cols[4].append(np.frombuffer(own, "<i4"))
                out = [keys.take(pa.array(rows, pa.int32())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array(cols[4], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(lean(cut), schema)


class SumOfSquares:
    """Places lengths into sequences of one capacity; keeps counts per gap and one stack of sequences per gap."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        if length == self.capacity:
            self.opened += 1
            return self.opened - 1, 0
        count = self.count
        here = count[length:]
        change = 2 * (count[: self.capacity + 1 - length] - here + 1)
        change[0] = 1 - 2 * count[length]
        change[here == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        rest = self.capacity - length
        if here[best] and change[best] <= 2 * count[rest] + 1:
            gap = best + length
            at, offset = self.open[gap].pop(), self.capacity - gap
            count[gap] -= 1
            rest = best
        else:
            at, offset = self.opened, 0
            self.opened += 1
        if rest:
            self.open[rest].append(at)
            count[rest] += 1
        return at, offset


def place(rows: DataFrame, n_docs: int, *, capacity: int = CAPACITY, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """rows of pieces() with sequence_id and offset. n_docs: about how many documents they come from."""
    buckets = max(1, -(-n_docs // bucket_docs))
    names = rows.columns
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        after = TaskContext.get().partitionId() << 40  # the next sequence that no piece is in
        now, base, packer = None, after, None
        for batch in batches:
            seq, off = [], []
            for bucket, length in zip(batch.column(len(names)).to_pylist(), batch.column("length").to_pylist()):
                if bucket < 0:
                    seq.append(after)
                    off.append(0)
                    after += 1
                    continue
                if bucket != now:
                    now, base, packer = bucket, after, SumOfSquares(capacity)
                at, offset = packer.place(length)
                after = base + packer.opened
                seq.append(base + at)
                off.append(offset)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    # full pieces need no company: dealt over everything, they follow the buckets as sequences of their own
    bucket = F.when(F.col("length") < capacity, F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 16)))
    n = partitions(rows.sparkSession)
    return (
        rows.withColumn("_bucket", bucket)
        .repartition(n, "_bucket")
        .sortWithinPartitions("_bucket", F.desc("length"), "doc_id", "piece")
        .mapInArrow(lean(fill), schema)
    )


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, bucket_docs: int = BUCKET_DOCS, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset: every document packed into sequences of `capacity` ids."""
    return place(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, keep_ids=keep_ids), docs.count(), capacity=capacity, bucket_docs=bucket_docs)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids array<int>, doc_ids: the training sequences of a pack(keep_ids=True) result; a group has at most `capacity` ids."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
