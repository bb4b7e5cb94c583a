r"""License scans with a positional rare-token index.

Words are runs of [a-z0-9] and of characters from U+0080 on, after lower-casing A-Z. Two things are looked
for in every whole text: the base phrases (their words standing consecutively), and the license templates of
TEMPLATES. For a template, the index has the places of each of its words. A text's rarest `rare_words`
license words (by inverse document frequency over the whole corpus) are looked up; a template's places are
intersected with the text's by relative position (text place minus template place, in windows of
`slack` words, as wording varies a little), and where a window holds at least `least` of the template's idf weight,
all the template's words around it are counted. It is a finding if they hold `least` of the weight and the mandatory key phrases
stand there.

Scale: no shuffle of texts. One pass counts the documents that have each license word (a few hundred words,
fixed by TEMPLATES, summed per task and then in all), a second scans; each text is handled on its own.

Null text counts as empty: no words, no labels, score 0. Repeated rows repeat their findings. An empty table
gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
RARE_WORDS, SLACK, LEAST = 24, 12, 0.8

#: label: (words of a notice, key phrases that it can't be without). Standard notices of public licenses.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("licensed under the apache license version 2 0", "in compliance with the license"),
    ),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("free software", "gnu general public license"),
    ),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "bsd-conditions": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    "cc-by-nc-4.0": ("cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-4.0": ("cc by 4 0", ("cc by 4 0",)),
    "mit-notice": ("released under the mit license", ("under the mit license",)),
    "cc-attribution": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
}

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Words before each place of phrase in joined (words with one space before, between and after them)."""
    found, at, before, last = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        before += joined.count(b" ", last, at)
        last = at
        found.append(before)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return found


@dataclass
class Index:
    """Positions of the templates' words, with the corpus's idf."""

    idf: dict[bytes, float]
    words: dict[str, list[bytes]] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    keys: dict[str, list[bytes]] = field(default_factory=dict)
    postings: dict[bytes, list[tuple[str, int]]] = field(default_factory=lambda: defaultdict(list))
    rarest: dict[str, bytes] = field(default_factory=dict)

    @classmethod
    def build(cls, n_docs: int, df: dict[bytes, int]) -> Index:
        index = cls({w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in VOCABULARY})
        for label, (text, keys) in TEMPLATES.items():
            words = index.words[label] = text.encode().split()
            index.weight[label] = sum(index.idf[w] for w in words)
            index.keys[label] = [k.encode() for k in keys]
            # some word of the first key phrase must be there
            index.rarest[label] = max(sorted(keys[0].encode().split()), key=lambda w: index.idf[w])
            for j, w in enumerate(words):
                index.postings[w].append((label, j))
        return index

    def scan(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """label: (share of the template's weight, first word) of the best finding of each template."""
        have = VOCABULARY.intersection(words)
        labels = {label for label, w in self.rarest.items() if w in have and all(k in have for key in self.keys[label] for k in key.split())}
        if not labels:
            return {}
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in have:
                at[w].append(i)
        rare = sorted(have, key=lambda w: (-self.idf[w], w))
        found: dict[str, tuple[float, int]] = {}
        for label in labels:
            own = self.words[label]
            own_rare = [w for w in rare if w in set(own)][:RARE_WORDS]
            seen = sum(self.idf[w] * own.count(w) for w in own_rare)
            votes: dict[int, set[int]] = defaultdict(set)
            for w in own_rare:
                for name, j in self.postings[w]:
                    if name == label:
                        for i in at[w]:
                            votes[(i - j) // SLACK].add(j)
            for window, hits in votes.items():
                near = hits | votes.get(window + 1, set())
                if sum(self.idf[own[j]] for j in near) < LEAST * seen:
                    continue
                # the whole stretch, all words of the template, by counts
                low, high = max(0, window * SLACK), (window + 2) * SLACK + len(own)
                stretch = words[low:high]
                count, need = Counter(stretch), Counter(own)
                share = sum(self.idf[w] * min(n, count[w]) for w, n in need.items()) / self.weight[label]
                joined = b" " + b" ".join(stretch) + b" "
                if share >= LEAST and all(b" " + k + b" " in joined for k in self.keys[label]):
                    first = low + places(joined, self.keys[label][0])[0]
                    found[label] = max(found.get(label, (0.0, 0)), (min(1.0, share), -first))
        return {k: (s, -f) for k, (s, f) in found.items()}


VOCABULARY = frozenset(w for text, _ in TEMPLATES.values() for w in text.encode().split())


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Number of rows, and rows that have each word of VOCABULARY; counted over all rows, a few hundred numbers per task."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                df.update(VOCABULARY.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in df)], "n": pa.array([n, *df.values()], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word.encode(): r.n for r in rows}
    return found.pop(b"", 0), found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and findings (label, share, word) of each row."""
    n_docs, df = document_frequencies(docs)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, findings array<struct<label:string,share:double,word:long>>"
    finding = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("word", pa.int64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.build(n_docs, df)
        phrases = [(p.encode(), label) for p, label in PHRASES.items()]
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                words = words_of(text.as_py())
                starts: list[int] = []
                base: set[str] = set()
                joined = b" " + b" ".join(words) + b" "
                for phrase, label in phrases:
                    if phrase in joined and (at := places(joined, phrase)):
                        starts += at
                        base.add(label)
                found = index.scan(words)
                score = 1.0 if base else max((s for s, _ in found.values()), default=0.0)
                row = (
                    len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score,
                    [{"label": k, "share": s, "word": f} for k, (s, f) in sorted(found.items())],
                )
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), finding]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(look, schema)
