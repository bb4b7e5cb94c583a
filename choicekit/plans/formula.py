"""Model formulas: `y ~ a + b + a:b + a*b`."""

from __future__ import annotations

import re
from dataclasses import dataclass


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Formula:
    response: str
    #: main effects, then interactions, each in order of appearance
    mains: tuple[str, ...]
    interactions: tuple[tuple[str, ...], ...]

    @property
    def columns(self) -> list[str]:
        """Columns that the right side needs."""
        return list(dict.fromkeys([*self.mains, *(v for i in self.interactions for v in i)]))

    @property
    def labels(self) -> list[str]:
        return [*self.mains, *(":".join(i) for i in self.interactions)]


_NAME = re.compile(r"[A-Za-z.][\w.]*|`[^`]+`")


def parse(text: str) -> Formula:
    """Response and terms of a formula; `*` expands to main effects and interactions of every order, `- term` takes one away."""
    left, tilde, right = text.partition("~")
    if not tilde or not left.strip():
        raise FormulaError(f"a formula needs a response: {text!r}")
    terms: dict[frozenset, tuple[str, ...]] = {}

    def name(raw: str) -> str:
        raw = raw.strip()
        if not _NAME.fullmatch(raw):
            what = "offset() is an argument of the fit, not a term" if raw.startswith("offset(") else "transform the column before the fit"
            raise FormulaError(f"term {raw!r} is not a column name; {what}")
        return raw.strip("`")

    for sign, piece in re.findall(r"(^|[+-])\s*((?:[^+\-`]|`[^`]*`)+)", right.strip()):
        piece = piece.strip()
        if piece in ("0", "1"):
            continue  # a conditional model has no intercept
        found: list[tuple[str, ...]] = [()]
        for factor in piece.split("*"):
            own = tuple(dict.fromkeys(name(v) for v in factor.split(":")))
            found = [*found, *(tuple(dict.fromkeys([*f, *own])) for f in found)] if "*" in piece else [own]
        for term in sorted((f for f in found if f), key=len):
            if sign == "-":
                terms.pop(frozenset(term), None)
            else:
                terms.setdefault(frozenset(term), term)
    if not terms:
        raise FormulaError(f"no terms on the right of {text!r}")
    ordered = sorted(terms.values(), key=len)
    return Formula(left.strip().strip("`"), tuple(t[0] for t in ordered if len(t) == 1), tuple(t for t in ordered if len(t) > 1))
