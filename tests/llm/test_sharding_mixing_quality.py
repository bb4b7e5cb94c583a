from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from choicekit.llm import mixing, quality, sharding
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, lang string, shard int, times int, w int"


def documents(spark, n=700):
    """A hot source, a null one, an empty one, null and long texts, repeated rows, clashing column names."""
    rows = []
    for i in range(n):
        source = "hot" if i % 3 else ("b" if i % 2 else None) if i % 7 else "a"
        rows.append((i, None if i % 50 == 49 else "word " * (i * 37 % 90) + f"x{i}", source, "en", 9, 9, 9))
    rows += [(5, "word word", "hot", "en", 9, 9, 9)] * 3 + [(n, "", "empty", "en", 9, 9, 9), (None, "no id", "a", "en", 9, 9, 9), (n + 1, "é " * 5000, "b", "en", 9, 9, 9)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("bucket_rows", [10, 20_000])
def test_interleave(spark, bucket_rows):
    rows, df = documents(spark)
    got = sharding.interleave(df, bucket_rows=bucket_rows).collect()
    n = len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.source) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for d, t, s, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(16)) and {len(v) for v in by.values()} <= {n // 16, n // 16 + 1}
    total = Counter(r.source for r in got)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        c = Counter(r.source for r in own)
        assert all(abs(c[s] - total[s] / 16) < 3 for s in total)
    again = sharding.interleave(df.repartition(3), bucket_rows=bucket_rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_interleave_few(spark):
    _, df = documents(spark)
    assert sorted(r.shard for r in sharding.interleave(df.filter("doc_id < 4")).collect()) == [0, 1, 2, 3]
    assert sharding.interleave(df.limit(0)).collect() == []


def test_write_shards(spark, tmp_path):
    _, df = documents(spark, 64)
    df = df.filter("doc_id is not null and doc_id != 5")
    sharding.write_shards(df, f"file://{tmp_path}/s", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == df.count() and back.select("shard").distinct().count() == 4


def water(sizes, weights, total):
    """Water-filling as it is told: clamp, reshare, until none is above."""
    target, free, left = {}, dict(sizes), total
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > 2 * sizes[s]]
        if not over:
            target |= {s: left * weights[s] / w for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        free = {s: v for s, v in free.items() if s not in over}
    return target


@pytest.mark.parametrize(("bucket_rows", "broadcast_sources"), [(10, 0), (20_000, 100)])
def test_mix(spark, bucket_rows, broadcast_sources):
    rows, df = documents(spark)
    got = mixing.mix(df, bucket_rows=bucket_rows, broadcast_sources=broadcast_sources).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for d, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = water(sizes, weights, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size and r.taken == r.times * r.size + r.more
    assert all(abs(taken[s] - target[s]) <= 5 for s in order) and sum(r.more > 0 for r in got) <= len(order) + 4
    again = mixing.mix(df.repartition(3), bucket_rows=10, broadcast_sources=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.apply(df, bucket_rows=bucket_rows, broadcast_sources=broadcast_sources)
    assert mixed.columns == df.columns
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r.size] += r.times
        want[r.doc_id, r.source, r.more] += r.more > 0
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    assert Counter((r[0], r[1], r[2]) for r in mixed.select("doc_id", "source", size).collect()) == +want
    first = spark.createDataFrame([(" a b\nc  d ", 1), (" a b\nc  d ", 3), ("a b", 1)], "t string, n int")
    assert [r[0] for r in first.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["a", "a b\nc", "a"]
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.apply(df.limit(0)).collect() == []


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    at = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


QUALITY = [
    None, "", "  \n\t ", "a b c", "a b c a b c", "a a a a a", "x y z\nx y z\n\n \nx y z ", "é ü ñ # * <a> | & $ %", "a b c d a b c e a b", "The quick fox. " * 30,
    " ".join(f"clean{i} words" for i in range(60)), " ".join(f"bad{i}%%%" for i in range(80)), " ".join(f"LOUD{chr(65 + i % 26) * (i % 5)}{chr(66 + i % 24)}X" for i in range(90)),
    "\n".join(f"line {i % 3} has some words in it" for i in range(40)), " ".join(str(i) for i in range(100, 200)), " ".join("w" * 30 + str(i) for i in range(70)), "hash " + " ".join(f"t{i % 97} u{i % 89}" for i in range(9000)), "a\x0bb\x0cc\rd\te",
]


def test_quality(spark):
    rows = [(i, t, 1) for i, t in enumerate(QUALITY)] + [(9, QUALITY[9], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, w int")
    got = quality.measure(df).collect()
    assert len(got) == len(rows)
    for r in got:
        n = brute_quality(QUALITY[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, r
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert 10 in kept and not kept & {11, 12, 13, 14, 15}
    left = quality.filter(df)
    assert {r.doc_id for r in left.collect()} == kept and left.columns == df.columns
    assert quality.measure(df.limit(0)).collect() == []


def test_rule_order(spark):
    df = spark.createDataFrame([(i, "word " * 60 if i % 2 else "x") for i in range(500)], "doc_id long, text string")
    never = quality.Rule("never", F.lit(False))
    often = quality.Rule("often", F.length("text") < 5)
    assert [r.name for r in quality.order_rules(df, [never, often])] == ["often", "never"]
    for order in ([never, often], [often, never]):
        assert df.filter(quality.passes(order)).count() == 250
    bomb = quality.Rule("bomb", F.raise_error(F.lit("evaluated")).cast("boolean"))
    assert df.filter(quality.passes([quality.Rule("all", F.lit(True) & (F.col("doc_id") >= 0)), bomb])).count() == 0


def test_cascade():
    """Rejections per cost among the rows that are left, costs as powers of two, ties in the given order."""
    rejected = [[True, True, False]] * 6 + [[False, False, True]] * 2 + [[False, True, False]]
    assert quality.cascade(rejected, [1.0, 1.0, 1.0]) == [1, 2, 0]  # after 1 nothing is left for 0
    assert quality.cascade(rejected, [1.0, 8.0, 1.0]) == [0, 2, 1]
    assert quality.cascade(rejected, [1.0, 1.1, 0.9]) == [1, 2, 0] and quality.cascade([], [1.0, 2.0]) == [0, 1]


def test_rule_order_is_that_of_costs(spark):
    """Of rules that reject the same rows the cheap one comes first, in every run, wherever they stand."""
    df = spark.createDataFrame([(i, f"w{i % 97} " * 600 if i % 2 else "x") for i in range(400)], "doc_id long, text string").repartition(5)
    cheap = quality.Rule("cheap", F.length("text") < 5)
    dear = quality.Rule("dear", (F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) < 5) & (F.size(quality.words_of(F.col("text"))) < 3))
    for rules in ([cheap, dear], [dear, cheap], [dear, cheap]):
        assert [r.name for r in quality.order_rules(df, rules)] == ["cheap", "dear"]
