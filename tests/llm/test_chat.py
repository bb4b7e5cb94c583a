from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from choicekit.llm import chat


def render(source, **names):
    return "".join(x for x in chat.compile_template(source)(names) if isinstance(x, str))


def test_language():
    assert render("a{{ x.y }}b{# no #}c", x={"y": "1"}) == "a1bc"
    assert render("{% for i in xs %}{% if loop.first %}^{% endif %}{{ i }},{% endfor %}", xs=["p", "q"]) == "^p,q,"
    assert render("{% if a == 'x' or not b %}1{% elif 'k' in c %}2{% else %}3{% endif %}", a="y", b=True, c={"k": 0}) == "2"
    assert render("{% set z = 'q' + x %}{{ z | upper }}{{ z['a'] }}", x="w") == "QW"
    for bad in ("{{ x.__class__ }}", "{{ f() }}", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | nope }}", "{{ }}", "{% import os %}", "{{ a $ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert render("{{ x.upper }}{{ x['a'] }}", x="text") == ""


def test_folding():
    tree = chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if true and not false %}c{% else %}{{ x }}{% endif %}{% if 'q' in 'w' %}d{% endif %}{{ x ~ 'e' ~ 'f' }}"))
    assert tree == ("block", [("text", "ab1c"), ("out", ("~", ("name", "x"), ("const", "ef")))])


@given(st.lists(st.tuples(st.text(max_size=8), st.text(alphabet=st.sampled_from("\\#<:/turn> \nA"), max_size=30))))
def test_round_trip(turns):
    text = render(chat.DEFAULT, messages=[{"role": r, "text": t} for r, t in turns])
    assert list(chat.read_turns(text)) == turns


@pytest.mark.parametrize("part_chars", [1, 1 << 20])
def test_digests(spark, part_chars):
    hard = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", hard), (1, 2, "assistant", hard), (2, 0, None, None), (None, 5, "user", "n"), (-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i}\nx#") for i in range(500)] + [(1, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    parts = chat.format_conversations(df, part_chars=part_chars)
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        own = [(b or "", c or "") for _, b, c in sorted(((t, x, y) for k, t, x, y in rows if k == conv), key=lambda z: z[0])]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].formatted_chars == len("### : </turn>\n")
    if part_chars == 1:
        assert parts.filter("conv_id = 3").count() >= 500
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []
