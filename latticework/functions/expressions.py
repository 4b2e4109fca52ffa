"""Arithmetic expressions of numbers and variables as column expressions.

The grammar has + - * / with unary minus, parentheses, numbers with exponents, and the functions below in any case.
`legacy=True` reads chains of + and - from the right, a-b+c as a-(b+c), as users of old configurations expect; the
default reads them from the left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions import ieee

FUNCTIONS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "sqrt": F.sqrt,
    "sind": lambda c: F.sin(F.radians(c)), "cosd": lambda c: F.cos(F.radians(c)), "tand": lambda c: F.tan(F.radians(c)),
}

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|([-+*/()]))")


def parse(text: str, variables: dict[str, Column] | None = None, legacy: bool = False) -> Column:
    """The column of an expression; names that are no function are variables, by default columns of that name."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place][3] if place < len(tokens) else None

    def atom() -> Column:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the expression ends too early")
        m = tokens[place]
        place += 1
        if m[1]:
            return F.lit(float(m[1]))
        if m[2]:
            if peek() == "(":
                f = FUNCTIONS.get(m[2].lower())
                if f is None:
                    raise ValueError(f"no function {m[2]!r}")
                return f(atom())
            return (variables or {}).get(m[2], F.col(m[2]))
        if m[3] == "-":
            return -atom()
        if m[3] == "(":
            inner = total()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            place += 1
            return inner
        raise ValueError(f"{m[3]!r} is out of place")

    def product() -> Column:
        nonlocal place
        out = atom()
        while peek() in ("*", "/"):
            op = peek()
            place += 1
            other = atom()
            out = out * other if op == "*" else ieee.div(out, other)
        return out

    def total() -> Column:
        nonlocal place
        out = product()
        while peek() in ("+", "-"):
            op = peek()
            place += 1
            other = total() if legacy else product()
            out = out + other if op == "+" else out - other
        return out

    out = total()
    if place != len(tokens):
        raise ValueError(f"cannot read from {text[tokens[place].start() :]!r}")
    return out
