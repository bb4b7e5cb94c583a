from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from choicekit.llm import spanhash


@given(st.text(alphabet="ab\U0001f600", max_size=40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40))
def test_spans(text, i, j, n):
    p = spanhash.Prefixes(spanhash.codes_of(text))
    i, j = min(i, len(text)), min(j, len(text))
    n = min(n, len(text) - max(i, j))
    assert (p.span(i, i + n) == p.span(j, j + n)) == (text[i : i + n] == text[j : j + n])
    same = 0
    while max(i, j) + same < len(text) and text[i + same] == text[j + same]:
        same += 1
    assert spanhash.common_extension(p, i, p, j) == same
    if n:
        assert p.spans(n)[i] == p.span(i, i + n)[0]


def test_likeness():
    rng = np.random.default_rng(0)
    a = rng.integers(97, 123, 4000).astype("<u4")
    b = np.concatenate([a[:3000], rng.integers(97, 123, 1000).astype("<u4")])
    f = [spanhash.fingerprint(spanhash.Prefixes(x)) for x in (a, b, a[::-1].copy(), a.copy(), np.tile(a[:3], 2000), a[:0])]
    assert f[0] == f[3] and spanhash.likeness(f[0], f[3]) == 1
    assert abs(spanhash.likeness(f[0], f[1]) - 0.75) < 0.15 and spanhash.likeness(f[0], f[2]) < 0.05
    assert len(f[4].rsplit("-", 1)[1]) == 3 * 8 and spanhash.likeness(f[5], f[0]) == 0 and spanhash.likeness(f[5], f[5]) == 1


TEXTS = ["first text, " * 9, None, "", "abc", "abcd", "été \U0001f600 " * 50, "x" * 9000, "x" * 9000, *(f"document {i} has words {i * i} " * (i % 7 + 1) for i in range(60))]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    out = []
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        f, e, x = (spanhash.fingerprint(spanhash.Prefixes(spanhash.codes_of(s))) for s in (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, spanhash.likeness(f, e), spanhash.likeness(f, x)))
    return sorted(out)


def test_compare_edits(spark):
    rows = [(i * 10 - 50, t) for i, t in enumerate(TEXTS)] + [(10, TEXTS[6]), (10, "twice")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars int").repartition(5)
    got = spanhash.compare_edits(df)
    assert sorted(tuple(r)[:7] for r in got.collect()) == brute(rows)
    assert sorted((r.doc_id, r.n_chars, r.fingerprint) for r in spanhash.fingerprints(df).collect()) == [(d, n, f) for d, n, _, f, *_ in sorted(brute(rows), key=lambda r: (r[0], r[1], r[3]))]
    assert sorted(tuple(r)[:7] for r in spanhash.compare_edits(df.filter("doc_id = -50")).collect())[0][6] == 1.0
    assert spanhash.compare_edits(df.limit(0)).collect() == []
