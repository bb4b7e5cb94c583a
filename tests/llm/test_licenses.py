from __future__ import annotations

import re

from choicekit.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
    return words, sorted(i for v in at.values() for i in v), sorted({licenses.PHRASES[p] for p, v in at.items() if v})


MIT = licenses.TEMPLATES["mit-grant"][0]
TEXTS = [
    None, "", "x", "Released under the MIT License.", "MIT\x00license Mit  LICENSE mit licenses", "cc by cc by; CC-BY-NC 4.0", "GNU General Public License, Apache License", "été Ünder the cc by Ünder",
    "some text before. " * 40 + MIT.replace("without limitation", "with no limitation") + " more" * 50, MIT.replace("hereby", "never"), "Licensed under the Apache License, Version 2.0.",
    "software permission granted charge hereby free of", "This work is licensed under the GNU General Public License, version 3.",
]


def test_scan(spark):
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1.5)], "doc_id long, text string, score double")
    rows = licenses.scan(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        words, at, base = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words), len(at)), r
        assert (r.first_word, r.last_word) == ((at[0], at[-1]) if at else (None, None))
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    by = {r.doc_id: r.labels.split(",") for r in rows}
    assert "mit-grant" in by[8] and "mit-grant" not in by[9] and by[11] == [""] and by[2] == [""]
    assert by[10] == ["apache", "apache-2.0"] and by[12] == ["gpl", "gpl-3.0"] and by[5] == ["cc-by", "cc-by-nc-4.0"]
    assert licenses.scan(df.limit(0)).collect() == []


def test_frequencies(spark):
    n, df = licenses.document_frequencies(spark.createDataFrame([("MIT mit",), ("mit license",), (None,)], "text string"))
    assert n == 3 and df == {b"mit": 2, b"license": 1}
