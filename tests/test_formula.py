from __future__ import annotations

import pytest

from choicekit.plans.formula import FormulaError, parse


def test_terms():
    f = parse("y ~ a + b:c + a*d + `odd name`")
    assert f.response == "y" and f.mains == ("a", "d", "odd name") and f.interactions == (("b", "c"), ("a", "d"))
    assert f.columns == ["a", "d", "odd name", "b", "c"] and f.labels == ["a", "d", "odd name", "b:c", "a:d"]
    assert parse("y ~ a*b*c").labels == ["a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"]
    assert parse("y ~ a + a:b + b:a - a + 1").labels == ["a:b"]


@pytest.mark.parametrize("bad", ["y", "~ a", "y ~", "y ~ log(x)", "y ~ a + I(b)", "y ~ offset(z)", "y ~ 1"])
def test_errors(bad):
    with pytest.raises(FormulaError):
        parse(bad)
