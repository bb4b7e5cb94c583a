from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from choicekit.llm import simhash
from choicekit.llm.components import connected_components


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("length", [3, 5, 7])
def test_links_join_what_all_pairs_join(spark, length, monkeypatch):
    rng = np.random.default_rng(length)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for x in list(fps)[:20]:
        for _ in range(12):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
            x = y if rng.random() < 0.5 else x
    center = int(rng.integers(0, 1 << 63))
    fps |= {center ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.links(df, length)).collect()}
    ids = [signed(x) for x in fps]
    want = brute_components(fps, ids)
    assert {i: got.get(i, i) for i in ids} == dict(zip(ids, want))


def test_pigeonring_holds():
    rng = np.random.default_rng(0)
    sets = {n: simhash.chain_keys(n) for n in (3, 5, 7)}
    for _ in range(2000):
        x = 0
        for b in rng.choice(64, 4, replace=False):
            x |= 1 << int(b)
        ok = [s for s in range(8) if simhash.near(np.array([x], np.uint64), np.array([s]))[0]]
        assert ok
        for keys in sets.values():
            assert all(any(s == start and not x & mask for start, mask in keys) for s in ok)


TEXTS = ["", None, "one", "One", "a b c", "a b c d", "A  b\tc\nd e", "x y z " * 500, "été  ÉTÉ à b c d", *(f"w{i} common words in a row that go on and on w{i % 3}" for i in range(30)), "word " * 3000]


def test_components(spark):
    docs = spark.createDataFrame([(i + 5, t, 1) for i, t in enumerate(TEXTS)] + [(7, TEXTS[2], 1)], "doc_id long, text string, fp int")
    rows = simhash.components(docs).collect()
    fps = [brute_fp(t) for t in TEXTS]
    want = brute_components(fps, range(5, 5 + len(TEXTS)))
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert r.fp == signed(fps[r.doc_id - 5]) and r.component_id == want[r.doc_id - 5]
    kept = simhash.dedup(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want)) and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.components(docs.limit(0)).collect() == []


def test_path_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 99}


def test_dedup_keeps_rows_that_only_share_an_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (None, texts[4]), (8, texts[4]), (9, texts[4]), (5, texts[5]), (5, texts[5])]
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.doc_id) for r in kept if r.doc_id is not None) == sorted([(texts[2], 3), (texts[3], 3), (texts[4], 8), (texts[5], 5)])
    assert sorted(r.text for r in kept if r.doc_id is None) == texts[:2]


def test_near_sets_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(11)
    docs = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 400)))]
        docs.append(base)
        for _ in range(3):
            own = list(base)
            for at in rng.choice(len(own), max(1, int(len(own) * rng.uniform(0.005, 0.035))), replace=False):
                own[at] = f"x{rng.integers(0, 10**6)}"
            docs.append(own)
    docs += [["w1", "w2"], ["W1", "w2"], ["w1", "w3"]]
    sets = [{tuple(w.lower() for w in d[i : i + 5]) for i in range(max(1, len(d) - 4))} for d in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(docs))]
    got = simhash.dedup(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"), k=5, similarity=0.8).collect()
    assert len(pairs) > 60 and sorted(r.doc_id for r in got) == sorted(set(want))
    assert simhash.dedup(spark.createDataFrame([], "doc_id long, text string"), k=5, similarity=0.8).collect() == []


def test_near_sets_meet_by_the_ring(spark, monkeypatch):
    """The ring's step at its wider distance is part of the near-dedup stage, and joins all that differ in so few bits."""
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for x in list(fps):
        for _ in range(4):
            y = x
            for b in rng.choice(64, rng.integers(1, 9), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    ids = [signed(x) for x in sorted(fps)]
    got = {r.node: r.component for r in connected_components(simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long"), simhash.RING_LENGTH, simhash.RING)).collect()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if ((i ^ j) & (1 << 64) - 1).bit_count() <= simhash.RING:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: got.get(i, i) for i in ids} == {i: find(i) for i in ids} and len(got) > 60
    words = [f"w{x}" for x in rng.integers(0, 10**6, 900)]
    docs = [(0, " ".join(words[:300])), (1, " ".join([*words[:150], "changed", *words[151:300]])), (2, " ".join(words[300:600])), (3, " ".join(words[600:]))]
    called, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *how: called.append((sorted(r.fp for r in fps.collect()), how)) or links(fps, *how))
    kept = simhash.dedup(spark.createDataFrame(docs, "doc_id long, text string"), k=5, similarity=0.8).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3]
    assert called == [(sorted(simhash.sketch(simhash.shingles(t.encode(), 5))[1] for _, t in docs), (simhash.RING_LENGTH, simhash.RING))]
