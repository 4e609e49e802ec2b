"""The propensity formula: sums of features and interactions.

Grammar, loosest first: ``a + b`` adds terms, ``a * b`` stands for
``a + b + a:b``, ``a:b`` is an interaction, parentheses group.  Interactions
distribute over sums.  The result lists every term once, in order of appearance.
"""

from __future__ import annotations

import re


class FormulaParseError(ValueError):
    """A formula that the grammar has no reading for."""


Term = tuple[str, ...]
_TOKEN = re.compile(r"\s*(?:([A-Za-z_][\w.]*)|([-+*:()~]|\S))")


def _unique(terms: list[Term]) -> list[Term]:
    return list(dict.fromkeys(tuple(dict.fromkeys(t)) for t in terms))


def _cross(left: list[Term], right: list[Term]) -> list[Term]:
    return [a + b for a in left for b in right]


def parse_formula(text: str) -> list[Term]:
    """Terms of the formula as tuples of feature names."""
    symbols: list[tuple[str, bool]] = []
    at = 0
    body = text.rstrip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        symbols.append((m[1], True) if m[1] else (m[2], False))
        at = m.end()
    symbols.append(("end", False))
    place = 0

    def is_mark(mark: str) -> bool:
        return symbols[place] == (mark, False)

    def operand() -> list[Term]:
        nonlocal place
        value, is_name = symbols[place]
        place += 1
        if is_name:
            return [(value,)]
        if value == "(":
            inside = level(0)
            if not is_mark(")"):
                raise FormulaParseError("a parenthesis isn't closed")
            place += 1
            return inside
        raise FormulaParseError(f"a feature was expected, not {value!r}")

    merges = (
        ("+", lambda a, b: a + b),
        ("*", lambda a, b: a + b + _cross(a, b)),
        (":", _cross),
    )

    def level(depth: int) -> list[Term]:
        nonlocal place
        if depth == len(merges):
            return operand()
        mark, merge = merges[depth]
        terms = level(depth + 1)
        while is_mark(mark):
            place += 1
            terms = merge(terms, level(depth + 1))
        return terms

    terms = level(0)
    if not is_mark("end"):
        raise FormulaParseError(f"unexpected {symbols[place][0]!r}")
    return _unique(terms)


def term_to_str(term: Term) -> str:
    return ":".join(term)
