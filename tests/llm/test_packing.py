from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from choicekit.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    "", None, "it's the Hausaufgabe's", "ÀÉÎ ß µ ª 12³ ¼\xa0x\x85y", "a\x1cb c\x1fd", "été ΣΑΣ İstanbul 日本語  x", "x<|endoftext|>y",
    "don't, can'T; WE'LL!!! ###x --", "word " * 9000, "z" * 5000, "a\x00b \x7f", "x　y ​ z", "'S 'd's'tt",
]


def test_ids_match_the_tokenizer(monkeypatch):
    bpe = packing.WordBpe(PATH)
    for text, raw in zip(ODD, bpe([t or "" for t in ODD])):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(text)[:-1], text
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    assert [len(x) for x in packing.WordBpe(PATH)([t or "" for t in ODD])] == [4 * len(ids_of(t)) - 4 for t in ODD]


def test_pack(spark):
    texts = [*ODD, *(f"some words {i} " * (i % 97 + 1) for i in range(300)), *["the same"] * 50]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, texts[3], 5)], "doc_id long, text string, sequence_id int")
    packed = packing.pack(docs, PATH, bucket_docs=100, keep_ids=True)
    rows = packed.collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id, r.piece].append(r)
    for i, t in enumerate(texts):
        ids = ids_of(t)
        for k in range(0, len(ids), 4096):
            for r in found.pop((i, k // 4096)):
                own = ids[k : k + 4096]
                assert (r.start, r.length, r.ids) == (k, len(own), own) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert not found
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 4096) + 4
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(packed).collect()} == {k: sum(x[1] for x in v) for k, v in by.items()}


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_place_is_the_least_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    packer, gaps, where = packing.SumOfSquares(20), [], []
    for length in rng.integers(1, 21, 200).tolist():
        def cost(g):
            n = np.bincount([x for x in g if x], minlength=21)
            return int((n**2).sum())

        options = [cost([*gaps[:i], g - length, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= length] + [cost([*gaps, 20 - length])]
        at, offset = packer.place(length)
        if at == len(gaps):
            gaps.append(20)
        assert offset == 20 - gaps[at]
        gaps[at] -= length
        assert cost(gaps) == min(options)
