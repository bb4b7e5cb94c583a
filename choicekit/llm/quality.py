r"""Quality rules as a short-circuit cascade; DataFrame functions only.

A rule is a condition under which a document goes; rules read the column text, or what is measured of it already. On a sample of about
`sample_rows` rows of the whole table every rule's cost is timed, on as many copies of the sample as make the time stand out, and the rows it rejects are
noted. The cascade then is one CASE expression: first the rule with most rejections per cost, next the one with most
among the rows that are left, and so on, so that a row pays for a rule only if all before it let it pass. Costs count in
powers of two, so reruns agree. The order changes what is paid, never what is kept: the verdict is that no rule rejects.

Everything about a text is computed within its row: no shuffle, no explode. Repeated three-word windows are
found by sorting (hash of the window, position) as plain longs and comparing neighbours, word by word where
hashes agree, so a text of n words costs n log n.

Null text has no words and is rejected by the base rule; so is empty text. Repeated rows get the same
verdict. An empty table gives no rows. Extra columns are kept by filter() and dropped by measure().
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words_of

SYMBOLS, SAMPLE_ROWS, SEED = "[#*$%&|<>]", 1000, 3
#: Rows of more characters are no use for the sample; characters that a rule is timed on.
SAMPLE_CHARS, TIMED_CHARS = 1_000_000, 4_000_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, and only when the result is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _raw(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_matching(text: Column, kind: str) -> Column:
    """Number of characters of a class like [a-z]."""
    return F.length(F.regexp_replace(_raw(text), f"[^{kind[1:-1]}]+", "")).cast("long")


def n_words(text: Column) -> Column:
    return F.regexp_count(_raw(text), F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(_raw(text), r"[\x20\x09-\x0D]+", "")).cast("long")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(_raw(text), "\n"), lambda x: x.rlike(WORD))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more. words: a column or a lambda's variable, not an expression."""

    def covered(packed: Column, mask: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            i, j = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            equal = [F.get(words, i + k) == F.get(words, j + k) for k in range(3)]
            return (a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask)) == 0) & equal[0] & equal[1] & equal[2]

        def hit(sorted_: Column) -> Column:
            return F.filter(sorted_, lambda x, j: F.coalesce(same(x, F.get(sorted_, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_, j + 1)), F.lit(False)))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)

        positions = let(F.sort_array(packed), lambda s: F.sort_array(F.transform(hit(s), lambda x: x.bitwiseAND(mask))))
        return let(positions, total)

    n = F.size(words)
    mask = F.pow(F.lit(2.0), F.ceil(F.log2(n + F.lit(1.0)))).cast("long") - 1

    def windows(m: Column) -> Column:
        first = F.sequence(F.lit(0), n - 3)
        return F.transform(first, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(mask, lambda m: covered(windows(m), m)))


@dataclass(frozen=True)
class Rule:
    name: str
    #: true for texts that go
    rejects: Column


def base_rules(text: Column) -> list[Rule]:
    return [
        Rule("few_words", n_words(text) < 50),
        Rule("repeats", let(words_of(text), lambda w: 100 * n_repeat_words(w) > 50 * F.size(w))),
    ]


def measured(text: Column) -> dict[str, Column]:
    """What rules read of a text besides the text itself."""
    return {
        "n_words": n_words(text), "word_chars": word_chars(text), "n_symbols": n_matching(text, SYMBOLS),
        "n_lines": let(lines_of(text), lambda x: F.size(x).cast("long")), "n_dup_lines": let(lines_of(text), n_dup_lines),
    }


def text_rules(text: Column, known: dict[str, Column] | None = None) -> list[Rule]:
    """The rules of the method: symbols, long or short words, repeated lines, letters and capitals. known: columns that hold measured()."""
    m = known or measured(text)
    lines = 100 * m["n_dup_lines"] > 40 * m["n_lines"] if known else let(lines_of(text), lambda x: 100 * n_dup_lines(x) > 40 * F.size(x))
    return [
        Rule("symbols", 10 * m["n_symbols"] > m["n_words"]),
        Rule("word_length", let(m["n_words"], lambda n: let(m["word_chars"], lambda c: (c < 2 * n) | (c > 14 * n)))),
        Rule("dup_lines", lines),
        Rule("letters", 100 * n_matching(text, r"[\p{L}]") < 60 * m["word_chars"]),
        Rule("capitals", let(F.regexp_replace(_raw(text), r"[^\p{L}]+", ""), lambda x: 100 * F.length(F.regexp_replace(x, r"[^\p{Lu}]+", "")) > 40 * F.length(x))),
    ]


def cascade(rejected: list[list[bool]], costs: list[float]) -> list[int]:
    """An order of rules: always the one with most rejections per cost among the rows that are left (costs as powers of two; ties keep the given order)."""
    left, rest, out = rejected, list(range(len(costs))), []
    while rest:
        best = max(rest, key=lambda k: (sum(row[k] for row in left) / 2.0 ** round(math.log2(costs[k])), -k))
        out.append(best)
        rest.remove(best)
        left = [row for row in left if not row[best]]
    return out


def order_rules(docs: DataFrame, rules: list[Rule], *, sample_rows: int = SAMPLE_ROWS, seed: int = SEED, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> list[Rule]:
    """rules, which read columns of prepare(docs), in the order of cascade() on a sample of docs."""
    n = docs.count()
    if not n:
        return rules
    # the sample is bounded in rows and bytes, and comes from all partitions
    share = min(1.0, 1.1 * sample_rows / n + 8 / n)
    texts = docs.select("text").sample(share, seed).filter(F.coalesce(F.length("text"), F.lit(0)) < SAMPLE_CHARS).limit(sample_rows).collect()
    chars = sum(len(r.text or "") for r in texts)
    plain = docs.sparkSession.createDataFrame([(r.text,) for r in texts], "text string")
    own = prepare(plain).collect()
    if not own:
        return rules
    held = docs.sparkSession.createDataFrame(own, prepare(plain).schema).coalesce(1)
    rejected = [list(r[0]) for r in held.select(F.array(*(F.coalesce(x.rejects, F.lit(False)) for x in rules))).collect()]
    many = held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, min(1000, TIMED_CHARS // max(chars, 1)))))))
    # that a copy counts keeps Spark from computing a rule once for all copies
    varied = many.withColumn("text", F.concat(_raw(F.col("text")), F.when(F.col("_copy") < 0, F.lit("x")).otherwise(F.lit(""))))

    def timed(column: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            varied.agg(F.max(F.length("text")), column).first()
            best = min(best, time.perf_counter() - began)
        return best

    floor = timed(F.count(F.lit(1)))
    costs = [max(timed(F.count_if(x.rejects)) - floor, 0.02) for x in rules]
    return [rules[k] for k in cascade(rejected, costs)]


def passes(rules: list[Rule]) -> Column:
    """The cascade: false as soon as a rule rejects; later rules are not evaluated then."""
    verdict = None
    for rule in rules:
        verdict = F.when(rule.rejects, F.lit(False)) if verdict is None else verdict.when(rule.rejects, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def filter(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects."""
    text = F.col("text")
    return docs.filter(passes(order_rules(docs, base_rules(text) + text_rules(text), sample_rows=sample_rows)))


def measure(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row."""
    text = F.col("text")

    def columns(df: DataFrame, *kept: str) -> DataFrame:
        rows = df.select(*kept, "text", words_of(text).alias("w"), lines_of(text).alias("l"))
        return rows.select(
            *kept, "text", F.size("w").cast("long").alias("n_words"), word_chars(text).alias("word_chars"), n_matching(text, SYMBOLS).alias("n_symbols"),
            F.size("l").cast("long").alias("n_lines"), n_dup_lines(F.col("l")).alias("n_dup_lines"), n_repeat_words(F.col("w")).alias("n_repeat_words"),
        )

    rules = order_rules(docs, text_rules(text, {c: F.col(c) for c in measured(text)}), sample_rows=sample_rows, prepare=columns)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = columns(docs, "doc_id").withColumn("base_failed", failed)
    return rows.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(rules))).drop("text", "n_lines")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM i),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, i AS pos FROM r UNION ALL SELECT rid, i + 1 FROM r UNION ALL SELECT rid, i + 2 FROM r) GROUP BY rid),
m AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, regexp_replace(t, '[^\p{L}]+', '', 'g') AS letters
      FROM w LEFT JOIN p ON w.rid = p.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 10 * n_symbols > n_words AND NOT (word_chars < 2 * n_words OR word_chars > 14 * n_words)
       AND NOT 100 * n_dup_lines > 40 * n_lines AND NOT 100 * length(letters) < 60 * word_chars
       AND NOT 100 * length(regexp_replace(letters, '[^\p{Lu}]+', '', 'g')) > 40 * length(letters) AS kept
FROM b
"""
